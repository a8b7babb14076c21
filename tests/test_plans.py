"""Plan-shape helpers against brute force, including a key that holds most of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.operators import graph, joins, pixels, stats, windows
from rivulet.plans.intervals import interval_join
from rivulet.plans.quantiles import exact_quantiles
from rivulet.plans.ranks import value_counts_below
from rivulet.plans.runs import find_runs
from rivulet.plans.timechunks import DAY, HOUR, STEP, over_axis, over_time

rng = random.Random(7)


@pytest.mark.parametrize("n_hot", [50, 60_000])
def test_exact_quantiles_equal_numpy(spark, n_hot):
    local = np.random.default_rng(3)
    data = {"hot": np.round(local.gamma(2.0, 3.0, n_hot), 3), "small": np.array([5.0, 1.0, 1.0]), "one": np.array([2.5])}
    pdf = [(k, float(v)) for k, arr in data.items() for v in arr]
    df = spark.createDataFrame(pdf, "k string, v double").unionByName(spark.createDataFrame([("small", None)], "k string, v double"))
    probs = {"p01": 0.01, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p0": 0.0, "p100": 1.0}
    for row in exact_quantiles(df, ["k"], "v", probs).collect():
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(data[row["k"]], p), abs=1e-9), (row["k"], name)
    overall = exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert overall == pytest.approx(np.median(np.concatenate(list(data.values()))))


def test_counts_below_equal_sorting(spark):
    vals = [rng.randint(0, 40) / 4 for _ in range(3000)]
    df = spark.createDataFrame([("a", v) for v in vals] + [("b", 1.0)], "k string, v double")
    for r in value_counts_below(df, ["k"], "v", buckets=8).where("k = 'a'").collect():
        assert r["n_below"] == sum(x < r["v"] for x in vals)
        assert r["n_equal"] == vals.count(r["v"])
        assert r["n_total"] == len(vals)


def test_runs_cross_slices_and_match_a_walk(spark, readings):
    minutes = sorted(rng.sample(range(0, 60 * 24 * 20, 15), 700))
    df = readings([("s", m, float(m % 7)) for m in minutes])
    for chunk in (HOUR * 3, DAY, 400 * DAY):
        got = find_runs(df, ["series_id"], "ts", 30 * 60 * 1_000_000, {"total": ("sum", F.col("value"))}, chunk=chunk)
        rows = sorted((r["run_start"].timestamp(), r["n_rows"], r["total"]) for r in got.collect())
        runs, cur = [], [minutes[0]]
        for a, b in zip(minutes, minutes[1:]):
            if b - a <= 30:
                cur.append(b)
            else:
                runs.append(cur)
                cur = [b]
        runs.append(cur)
        assert [(n, t) for _, n, t in rows] == [(len(r), float(sum(m % 7 for m in r))) for r in runs]


def test_window_slices_do_not_change_results(spark, readings):
    minutes = list(range(0, 60 * 24 * 9, 15))
    df = readings([("s", m, float((m * 31) % 17)) for m in minutes])
    frame = lambda w: {"x": F.avg("value").over(w.rangeBetween(-DAY + 1, 0)), "y": F.lead("value", 3).over(w)}
    small = over_time(df, ["series_id"], "ts", frame, before=DAY, after=3 * STEP, chunk=DAY)
    whole = over_time(df, ["series_id"], "ts", frame, before=DAY, after=3 * STEP, chunk=400 * DAY)
    assert small.count() == len(minutes)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, whole.collect()))


def test_axis_slices(spark):
    df = spark.createDataFrame([(1, c) for c in range(-20, 50) if c % 9], "row int, col int")
    count = lambda w: {"n": F.count(F.lit(1)).over(w.rangeBetween(-2, 2))}
    a = over_axis(df, ["row"], "col", count, 2, 2, chunk=5)
    cols = {r["col"] for r in df.collect()}
    assert {r["col"]: r["n"] for r in a.collect()} == {c: sum(c + d in cols for d in range(-2, 3)) for c in cols}


@pytest.mark.parametrize("deal", [False, True])
@pytest.mark.parametrize("closed", [True, False])
def test_interval_join_equals_nested_loop(spark, readings, deal, closed):
    pts = [("a", m, float(i)) for i, m in enumerate(rng.sample(range(0, 20000), 150))]
    ivs = [(i, "a" if i % 3 else "b", *sorted(rng.sample(range(0, 20000), 2))) for i in range(40)]
    p = readings(pts)
    iv = spark.createDataFrame(ivs, "id int, series_id string, s int, e int").selectExpr(
        "id", "series_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, s, 0) as start", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, e, 0) as end")
    got = sorted((r["value"], r["id"]) for r in interval_join(p, iv, "ts", "start", "end", on=["series_id"], closed=closed, deal=deal, rows=(7, 3)).collect())
    inside = lambda m, s, e: s <= m <= e if closed else s <= m < e
    assert got == sorted((v, i) for _, m, v in pts for i, k, s, e in ivs if k == "a" and inside(m, s, e))
    left = interval_join(p, iv, "ts", "start", "end", on=["series_id"], how="left_anti", closed=closed, deal=deal, rows=(7, 3))
    hit = {v for v, _ in got}
    assert sorted(r["value"] for r in left.collect()) == sorted(v for _, _, v in pts if v not in hit)


def test_nearest_equals_brute_force_with_crowded_places(spark):
    pts = [(i, round(rng.uniform(-60, 60), 3), round(rng.uniform(-179, 179), 3)) for i in range(60)] + [(100 + i, 51.5, -8.5) for i in range(60)]
    refs = [(i, round(rng.uniform(-60, 60), 3), round(rng.uniform(-179, 179), 3)) for i in range(25)] + [(200, 10.0, 10.0), (201, 10.0, 10.0)]
    p = spark.createDataFrame(pts, "node int, lat double, lon double")
    r = spark.createDataFrame(refs, "gauge int, lat double, lon double")

    def km(a, b):
        la, lo, lb, lp = map(np.radians, (*a, *b))
        return 2 * 6371 * np.arcsin(np.sqrt(np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2))

    got = {x["node"]: (x["gauge"], x["dist"]) for x in joins.nearest_on_globe(p, r, "gauge").collect()}
    assert len(got) == len(pts)
    for i, la, lo in pts:
        best = min((round(km((la, lo), (a, b)), 6), g) for g, a, b in refs)
        assert got[i][1] == pytest.approx(best[0], abs=2e-6)
        assert got[i][0] == best[1]


def test_k_nearest_equals_brute_force(spark):
    pts = [(i, rng.uniform(0, 90000), rng.uniform(0, 400)) for i in range(40)]
    df = spark.createDataFrame(pts, "node int, easting double, northing double")
    got = {}
    for r in joins.k_nearest(df, 4).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    for i, e, n in pts:
        order = sorted(((e - a) ** 2 + (n - b) ** 2, j) for j, a, b in pts if j != i)
        assert got[i] == {j for _, j in order[:4]}


def _greedy(peaks, sep):
    """Highest first, later first on a tie, as sequential reference."""
    kept = []
    for at, v in sorted(peaks, key=lambda x: (x[1], x[0]), reverse=True):
        if all(abs(at - k) >= sep for k, _ in kept):
            kept.append((at, v))
    return sorted(kept)


def test_thinned_peaks_equal_sequential_greedy(spark, readings):
    minutes = sorted(rng.sample(range(0, 60 * 24 * 12, 15), 350))
    peaks = [(m, float(rng.randint(0, 9))) for m in minutes] + [(60 * 24 * 15 + 45 * i, float(i)) for i in range(40)]
    df = readings([("s", m, v) for m, v in peaks])
    got = windows.thin_peaks(df, 4 * HOUR)
    base = min(r["ts"] for r in df.collect()).replace(hour=0, minute=0)
    rows = sorted((int((r["ts"] - base).total_seconds() // 60), r["value"]) for r in got.collect())
    shift = rows[0][0] - _greedy(peaks, 240)[0][0]
    assert [(a - shift, v) for a, v in rows] == _greedy(peaks, 240)


def test_local_maxima_plateaus_and_ends(spark, readings):
    vals = [5, 1, 3, 3, 3, 2, 4, 4, 6, 1, 7]
    df = readings([("s", 15 * i, float(v)) for i, v in enumerate(vals)])
    got = windows.local_maxima(df, F.lit(0.0)).collect()
    # the flat top 3,3,3 counts at its middle; 4,4 rises on; both ends are no maxima
    assert sorted(((r["ts"].hour * 60 + r["ts"].minute) // 15, r["value"]) for r in got) == [(3, 3.0), (8, 6.0)]


def test_components_chain_star_and_isolated(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 80)]
    edges = spark.createDataFrame(chain + star + [(900, 900)], "src long, dst long")
    ids = sorted({x for e in chain + star for x in e} | {900, 901})
    nodes = spark.createDataFrame([(i,) for i in ids], "node long")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges, nodes).collect()}
    assert got == {i: 100 if i <= 160 else 500 if i < 900 else i for i in ids}


def test_shortest_distances_cycles_and_unreachable(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 2.0), (1, 3, 9.0), (3, 3, 1.0), (8, 9, 4.0)], "src int, dst int, dist_km double")
    got = {(r["src"], r["dst"]): r["dist_km"] for r in graph.shortest_distances(e, 100.0).collect()}
    assert got == {(1, 2): 1.0, (2, 1): 1.0, (2, 3): 2.0, (1, 3): 3.0, (8, 9): 4.0}


def test_downstream_edges_first_reach_wins(spark):
    # 4 is reached from 2 and 3 in the same hop; the edge to 2 comes first
    e = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (3, 4, 2), (2, 4, 3), (4, 1, 4), (7, 8, 5), (8, 7, 6)], "src int, dst int, edge_order int")
    n = spark.createDataFrame([(1,), (7,), (9,)], "node int")
    got = sorted((r["source"], r["src"], r["dst"], r["hop"], r["gain"]) for r in graph.downstream_edges(n, e).collect())
    assert got == [(1, 1, 2, 1, 0.75), (1, 1, 3, 1, 0.75), (1, 2, 4, 2, 0.5625), (7, 7, 8, 1, 0.75)]


def test_opening_equals_two_passes(spark):
    wet = {(r, c) for r in range(12) for c in range(14) if rng.random() < 0.9}
    df = spark.createDataFrame(sorted(wet), "row int, col int")
    er = lambda m: {p for p in m if all((p[0] + i, p[1] + j) in m for i in (-1, 0, 1) for j in (-1, 0, 1))}
    di = lambda m: {(r + i, c + j) for r, c in m for i in (-1, 0, 1) for j in (-1, 0, 1)}
    want = di(di(er(er(wet))))
    assert {(r["row"], r["col"]) for r in pixels.opening(df).collect()} == want


def test_small_patches_need_an_edge_in_common(spark):
    big = {(r, c) for r in range(5) for c in range(10)}
    diagonal = {(5 + r, 10 + c) for r in range(7) for c in range(7)}
    df = spark.createDataFrame(sorted(big | diagonal), "row int, col int")
    kept = {(r["row"], r["col"]) for r in pixels.drop_small_patches(df, 50).collect()}
    assert kept == big  # 50 pixels stay, 49 touching only at a corner go


def test_flow_accumulation_and_hand(spark):
    dem = spark.createDataFrame([(r, c, float(r * 3 + c)) for r in range(8) for c in range(5)], "row int, col int, elev double")
    flow = pixels.flow_direction(dem)
    acc = {(r["row"], r["col"]): r["accumulation"] for r in pixels.flow_accumulation(flow).collect()}
    assert acc[(0, 0)] == 40 and max(acc.values()) == 40
    streams = spark.createDataFrame([(0, 0)], "row int, col int")
    hand = {(r["row"], r["col"]): r["hand"] for r in pixels.height_above_drainage(dem, flow, streams).collect()}
    assert hand == {(r, c): float(r * 3 + c) for r in range(8) for c in range(5)}


def test_lagged_products_equal_numpy(spark, readings):
    n, local = 300, np.random.default_rng(5)
    a, b = local.normal(size=n), local.normal(size=n)
    df = readings([("a", 15 * i, float(x)) for i, x in enumerate(a)] + [("b", 15 * i, float(x)) for i, x in enumerate(b)])
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    got = {r["lag"]: r["s"] for r in stats.lagged_products(df, pairs, -5, 9, STEP, block_steps=40).collect()}
    for k in range(-5, 10):
        assert got[k] == pytest.approx(sum(a[s] * b[s + k] for s in range(n) if 0 <= s + k < n))
