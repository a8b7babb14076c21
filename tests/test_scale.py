"""Joins and iterations where one place, day, key or row holds most of the data, against brute force."""

import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rivulet.functions import labels
from rivulet.operators import graph, joins, pixels, quality, stats
from rivulet.plans import intervals, nearest
from rivulet.plans.quantiles import exact_quantiles
from rivulet.plans.ranks import neighbours_in_order
from rivulet.plans.timechunks import STEP
from rivulet.sources import ingest, sinks
from rivulet.streaming import follow

rng = random.Random(11)
AT = "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, {})"


def _points(spark, seconds):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "p long, s int").selectExpr("p", f"{AT.format('s')} as ts")


def _spans(spark, spans):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i long, a int, b int").selectExpr("i", f"{AT.format('a')} as start", f"{AT.format('b')} as end")


# ---------------------------------------------------------------- range joins
@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_range_join_of_lengths_from_nothing_to_years(spark, how):
    seconds = [rng.randrange(0, 40_000_000) for _ in range(60)] + [86_400 * 3] * 40  # many at one instant
    spans = [(s, s) for s in seconds[:5]] + [(a, a + rng.choice([60, 7_200, 900_000, 30_000_000])) for a in (rng.randrange(0, 40_000_000) for _ in range(40))] + [(500, 100)]
    p, iv = _points(spark, seconds), _spans(spark, spans)
    got = intervals.interval_join(p, iv, "ts", "start", "end", how=how, rows=(9, 4))
    pairs = [(k, i) for k, s in enumerate(seconds) for i, (a, b) in enumerate(spans) if a <= s <= b]
    hit = {k for k, _ in pairs}
    if how in ("inner", "left"):
        want = pairs + ([(k, None) for k in range(len(seconds)) if k not in hit] if how == "left" else [])
        assert sorted((r["p"], -1 if r["i"] is None else r["i"]) for r in got.collect()) == sorted((k, -1 if i is None else i) for k, i in want)
        assert set(got.columns) == {"p", "ts", "i", "start", "end"}
    else:
        assert sorted(r["p"] for r in got.collect()) == sorted(k for k in range(len(seconds)) if (k in hit) == (how == "left_semi"))


def test_range_join_deals_out_one_day(spark):
    """All points on one day: no cell of the grid gets more than a bounded number of rows of either side."""
    p = spark.range(40_000).selectExpr("id as p", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id % 86400) as ts")
    iv = spark.range(600).selectExpr("id as i", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) as start", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 12, 0, id) as end")
    got = intervals.interval_join(p, iv, "ts", "start", "end", rows=(2_000, 100))
    exchanged = got.drop("start", "end")
    assert exchanged.count() == sum(min(39_999, i + 43_200) - i + 1 for i in range(600))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_gx" in plan and "_gy" in plan
    cells = got.groupBy(F.pmod(F.xxhash64("p", "ts"), F.lit(20)).alias("x")).agg(F.count_distinct("p").alias("n"))
    assert cells.agg(F.max("n")).first()[0] <= 2_000 * 1.3


def test_range_join_of_empty_sides(spark):
    p, iv = _points(spark, [1, 2]), _spans(spark, [(0, 5)])
    assert intervals.interval_join(p.where("false"), iv, "ts", "start", "end").count() == 0
    assert intervals.interval_join(p, iv.where("false"), "ts", "start", "end").count() == 0
    assert intervals.interval_join(p, iv.where("false"), "ts", "start", "end", how="left").count() == 2
    assert intervals.interval_join(p, iv.where("false"), "ts", "start", "end", how="left_anti").count() == 2


# ---------------------------------------------------------------- nearest
def _crowd(n, m, seed):
    """A hundredth of the points and half of the references in one tiny place."""
    r = np.random.default_rng(seed)
    pts = np.vstack([r.uniform(0, 1e6, (n - n // 100, 2)), 5e5 + r.normal(0, 0.5, (n // 100, 2))])
    refs = np.vstack([r.uniform(0, 1e6, (m // 2, 2)), 5e5 + r.normal(0, 0.5, (m - m // 2, 2))])
    return pts, refs


def test_nearest_with_a_crowd_in_one_place(spark):
    pts, refs = _crowd(3_000, 4_000, 5)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)], "p long, x double, y double")
    rf = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(refs)] + [(-1, None, 1.0)], "r long, x double, y double")
    got = {row["p"]: (row["r"], row["dist"]) for row in joins.nearest_planar(df, rf, ("x", "y"), "r").collect()}
    assert got.pop(-1) == got.pop(-2) == (None, None) and len(got) == len(pts)
    for i, place in enumerate(pts):
        d2 = ((refs - place) ** 2).sum(axis=1)
        assert got[i][1] == pytest.approx(float(np.sqrt(d2.min())), abs=1e-6)


def test_a_crowd_costs_depth_not_pairs(spark):
    pts, refs = _crowd(3_000, 4_000, 6)
    rf = spark.createDataFrame([(float(a), float(b), i) for i, (a, b) in enumerate(refs)], "x double, y double, r long")
    tree = nearest.CellTree(rf, ["x", "y"])
    assert tree.leaves.groupBy("_level", "_c0", "_c1").count().agg(F.max("count")).first()[0] <= nearest.LEAF
    assert tree.depth >= 8
    places = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "px double, py double")
    each = tree.candidates(places, ["px", "py"]).groupBy("px", "py").count().agg(F.count(F.lit(1)).alias("n"), F.avg("count").alias("mean"), F.max("count").alias("most")).first()
    assert each["n"] == len(pts) and each["mean"] < 80 and each["most"] < 500  # of 4,000


def test_k_nearest_with_ties_few_nodes_and_one_place(spark):
    rows = [(i, float(i % 5), 0.0) for i in range(20)]
    got = {}
    for r in joins.k_nearest(spark.createDataFrame(rows, "node int, easting double, northing double"), 3).collect():
        got.setdefault(r["src"], []).append((r["dist"], r["dst"]))
    for i, x, _ in rows:
        assert sorted(got[i]) == sorted((abs(x - a), j) for j, a, _ in rows if j != i)[:3]
    two = joins.k_nearest(spark.createDataFrame(rows[:2], "node int, easting double, northing double"), 3).collect()
    assert sorted((r["src"], r["dst"]) for r in two) == [(0, 1), (1, 0)]
    assert joins.k_nearest(spark.createDataFrame([], "node int, easting double, northing double"), 3).count() == 0


# ---------------------------------------------------------------- reach
def _breadth_first(sources, edges):
    out, ways = [], {}
    for s, d, o, lag in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if s != d and d not in {x[0] for x in ways.get(s, [])}:
            ways.setdefault(s, []).append((d, lag))
    for source in sources:
        seen, queue = {source}, [(source, 0, 0)]
        for at, hop, total in queue:
            for d, lag in ways.get(at, []):
                if d not in seen:
                    seen.add(d)
                    queue.append((d, hop + 1, total + (2 if lag is None else lag)))
                    out.append((source, at, d, hop + 1, total + (2 if lag is None else lag)))
    return out


def test_reach_keeps_the_first_path_of_the_queue(spark):
    for seed in range(4):
        r = random.Random(seed)
        edges = [(r.randrange(18), r.randrange(18), r.randrange(1_000), r.choice([None, 1, 3])) for _ in range(40)]
        table = spark.createDataFrame(edges, "src long, dst long, edge_order long, lag long")
        sources = spark.createDataFrame([(i,) for i in range(0, 18, 2)], "node long")
        got = graph.downstream_edges(sources, table, lag="lag")
        want = _breadth_first(range(0, 18, 2), edges)
        assert sorted((x["source"], x["src"], x["dst"], x["hop"], x["lag_steps"]) for x in got.collect()) == sorted(want)
        near = graph.downstream_edges(sources, table, max_hops=3, lag="lag")
        assert sorted((x["source"], x["dst"]) for x in near.collect()) == sorted((s, d) for s, _, d, h, _ in want if h <= 3)


def test_reach_takes_a_logarithmic_number_of_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "cut", lambda df, compact=False, f=graph.cut: rounds.append(1) or f(df, compact))
    edges = spark.range(1_000).selectExpr("id as src", "id + 1 as dst", "id as edge_order")
    reach = graph.downstream_edges(spark.createDataFrame([(0,), (400,)], "node long"), edges)
    assert reach.groupBy("source").agg(F.max("hop").alias("h"), F.count(F.lit(1)).alias("n")).orderBy("source").collect() == [(0, 1_000, 1_000), (400, 600, 600)]
    assert len(rounds) <= 12


# ---------------------------------------------------------------- unions, patches, lags, neighbours
@pytest.mark.parametrize("chunk", [3_600_000_000, 86_400_000_000, 10**15])
def test_union_of_intervals_equals_a_sweep(spark, chunk):
    spans = [("hot", a, a + rng.choice([0, 60, 4_000, 200_000])) for a in (rng.randrange(0, 3_000_000) for _ in range(300))] + [("one", 5, 10), ("one", 10, 12), ("one", 14, 13)]
    df = spark.createDataFrame(spans, "k string, a int, b int").selectExpr("k", f"{AT.format('a')} as s", f"{AT.format('b')} as e")
    got = sorted((r["k"], r["s"], r["e"]) for r in quality.merge_intervals(df, "k", "s", "e", chunk).collect())
    base = spark.sql("select timestamp_ntz '2024-01-01'").first()[0]
    want = []
    for k in ("hot", "one"):
        for a, b in sorted((a, b) for key, a, b in spans if key == k and a <= b):
            if want and want[-1][0] == k and a <= want[-1][2]:
                want[-1][2] = max(want[-1][2], b)
            else:
                want.append([k, a, b])
    assert [(k, (s - base).total_seconds(), (e - base).total_seconds()) for k, s, e in got] == [tuple(w) for w in want]


@pytest.mark.parametrize("tile", [1, 3, 1024])
def test_patches_cross_tiles(spark, tile):
    cells = {(r, c) for r in range(12) for c in range(21) if rng.random() < 0.6}
    df = spark.createDataFrame(sorted(cells), "row int, col int")
    got = {(r["row"], r["col"]): r["patch_size"] for r in pixels.drop_small_patches(df, 4, tile).collect()}
    left, want = set(cells), {}
    while left:
        patch, todo = set(), [left.pop()]
        while todo:
            r, c = todo.pop()
            patch.add((r, c))
            for near in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if near in left:
                    left.remove(near)
                    todo.append(near)
        if len(patch) >= 4:
            want |= dict.fromkeys(patch, len(patch))
    assert got == want


def test_patches_of_one_long_row(spark):
    row = spark.range(200_000).where("id <> 70000").selectExpr("0 as row", "id as col")
    got = pixels.drop_small_patches(row, 100_000).agg(F.count(F.lit(1)).alias("n"), F.min("col").alias("lo"), F.max("patch_size").alias("s")).first()
    assert tuple(got) == (129_999, 70_001, 129_999)


@pytest.mark.parametrize(("lo", "hi", "block"), [(0, 9, 16), (-5, 5, 64), (0, 200, 16)])
def test_lagged_products_equal_sums(spark, readings, lo, hi, block):
    a, b = [round(rng.uniform(-2, 2), 3) for _ in range(150)], [round(rng.uniform(-2, 2), 3) for _ in range(150)]
    df = readings([("a", 15 * i, v) for i, v in enumerate(a) if i % 7] + [("b", 15 * i, v) for i, v in enumerate(b)])
    pairs = spark.createDataFrame([("a", "b"), ("a", "a")], "a string, b string")
    got = {(r["a"], r["b"], r["lag"]): r["s"] for r in stats.lagged_products(df, pairs, lo, hi, STEP, block_steps=block).collect()}
    held = [v if i % 7 else 0.0 for i, v in enumerate(a)]
    for other, name in ((b, "b"), (held, "a")):
        for lag in range(lo, hi + 1):
            want = sum(held[i] * other[i + lag] for i in range(150) if 0 <= i + lag < 150)
            assert got.get(("a", name, lag), 0.0) == pytest.approx(want, abs=1e-9)


def test_neighbours_in_order(spark):
    names = sorted({f"n{rng.randrange(10_000)}" for _ in range(500)})
    got = {r["v"]: (r["before"], r["after"]) for r in neighbours_in_order(spark.createDataFrame([(n,) for n in [*names, *names[:9], None]], "v string").repartition(5), "v").collect()}
    assert got == {n: (names[i - 1] if i else None, names[i + 1] if i + 1 < len(names) else None) for i, n in enumerate(names)}


# ---------------------------------------------------------------- rules, files and partitions
def test_rules_of_a_table_by_position(spark):
    rules = labels.rule_table(spark, [("b+", "many"), ("a", "an a"), ("^c$", "only c")])
    texts = spark.createDataFrame([(1, "ab"), (2, "a"), (3, "c"), (4, None), (5, "d"), (5, "d"), (6, "")], "k int, t string")
    got = sorted((r["k"], r["label"]) for r in labels.label_by_table(texts, rules, "t", default="none").collect())
    assert got == [(1, "many"), (2, "an a"), (3, "only c"), (4, "none"), (5, "none"), (5, "none"), (6, "none")]
    assert {r["label"] for r in labels.label_by_table(texts, rules.where("false"), "t", default="none").collect()} == {"none"}


def test_blocks_survive_every_split(spark, tmp_path):
    blocks = [f"Station Number\t{i}\nStation Name\t{'n' * (i % 37)}" for i in range(500)]
    separator = "\n" + "-" * 20 + "\n"
    sinks.write_blocks(spark.createDataFrame([(b,) for b in blocks], "block string").repartition(2), f"{tmp_path}/b", separator)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("333", "4097", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = ingest.read_blocks(spark, f"{tmp_path}/b", separator)
            assert sorted(r["block"] for r in got.collect()) == sorted(blocks)
            assert size == "1m" or got.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path, schema = f"{tmp_path}/registry", "event_id string, scene_id string, v int, month int"
    rows = [(f"e{i}", f"s{i}", i, 202400 + i % 5) for i in range(50)]
    sinks.write_partitioned(spark.createDataFrame(rows, schema), path, ["month"])
    files = lambda m: {(p.name, p.stat().st_mtime_ns) for p in (tmp_path / "registry" / f"month={m}").iterdir()}
    before = {m: files(m) for m in range(202400, 202405)}
    fresh = [("e1", "z", 100, 202401), ("e1", "a", 99, 202401), ("new", "n", 7, 202499)]
    ingest.upsert_partitions(spark, path, spark.createDataFrame(fresh, schema), ["month"])
    got = {r["event_id"]: (r["scene_id"], r["v"], r["month"]) for r in spark.read.parquet(path).collect()}
    assert len(got) == 51 and got["e1"] == ("z", 100, 202401) and got["new"] == ("n", 7, 202499) and got["e6"] == ("s6", 6, 202401)
    assert {m for m in before if files(m) == before[m]} == {202400, 202402, 202403, 202404}
    with pytest.raises(ValueError, match="another partition"):
        ingest.upsert_partitions(spark, path, spark.createDataFrame([("e2", "q", 1, 202401)], schema), ["month"])
    ingest.upsert_partitions(spark, path, spark.createDataFrame([], schema), ["month"])
    assert spark.read.parquet(path).count() == 51


def test_wet_stretches_unfold_to_the_wet_pixels(spark):
    hour = 3_600_000_000
    stages = [(n, f"2024-01-01 {h:02d}:00:00", round(rng.uniform(0, 6), 2), 1.0) for n in (1, 2) for h in range(20) if rng.random() < 0.85]
    st = spark.createDataFrame(stages, "node int, t string, stage double, bankfull double").selectExpr("node", "cast(t as timestamp_ntz) as ts", "stage", "bankfull")
    cells = [(r, c, 1 + (r + c) % 2, round(rng.uniform(-1, 6), 1)) for r in range(4) for c in range(4)] + [(0, 0, 2, 2.0), (0, 0, 1, 1.5), (1, 1, 1, None), (2, 2, 1, 0.5), (2, 2, 1, 0.5)]
    px = spark.createDataFrame(cells, "row int, col int, node int, hand double")
    spans = pixels.inundation_spans(px, st, hour)
    unfolded = spans.selectExpr("row", "col", "explode(sequence(wet_from, wet_to, interval 1 hour)) as ts").collect()
    assert len(unfolded) == len(set(unfolded))
    assert {tuple(r) for r in unfolded} == {(r["row"], r["col"], r["ts"]) for r in pixels.inundation(px, st).collect()}
    ends = {(r["row"], r["col"], r["wet_to"]) for r in spans.collect()}
    assert not any((r["row"], r["col"], r["wet_from"] - timedelta(hours=1)) in ends for r in spans.collect())


# ---------------------------------------------------------------- similarity and streams
@pytest.mark.parametrize("threshold", [0.2, 0.9, -0.5])
def test_similar_pairs_equal_the_matrix(spark, threshold):
    r = np.random.default_rng(8)
    vectors = [[float(x) for x in v] for v in np.vstack([c + r.normal(0, 0.3, (12, 16)) for c in r.normal(0, 2, (6, 16))])] + [[1.0] * 16, None, [], [1.0, 2.0, 4.0], [2.0, 4.0, 8.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "k int, v array<double>")
    got = {(x["a"], x["b"]): x["similarity"] for x in stats.similar_pairs(df, "k", "v", threshold, pivots=5, block_rows=9).collect()}
    own = {i: np.array(v) - np.mean(v) for i, v in enumerate(vectors) if v}
    want = {}
    for i, x in own.items():
        for j, y in own.items():
            if i < j and len(x) == len(y) and np.linalg.norm(x) > 0 and np.linalg.norm(y) > 0:
                s = float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
                if s >= threshold:
                    want[i, j] = s
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)
    assert stats.similar_pairs(df.where("false"), "k", "v", threshold).count() == 0


def test_followed_files_come_once_and_slots_close(spark, tmp_path):
    put = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(["#station;a", *rows]) + "\n")
    (tmp_path / "in").mkdir()
    go = lambda: follow.catch_up(follow.reading_stream(spark, f"{tmp_path}/in", "level"), f"{tmp_path}/rows", f"{tmp_path}/c1")
    slots = lambda: follow.catch_up(follow.slot_stream(follow.reading_stream(spark, f"{tmp_path}/in", "level", late="1 hour")), f"{tmp_path}/slots", f"{tmp_path}/c2")
    put("level_7.csv", ["2024-01-01T00:00:00Z;1.0;254", "2024-01-01T00:05:00Z;3.0;254", "bad;1;1", "2024-01-01T00:05:00Z;3.0;254"])
    go(), slots()
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 2
    put("level_8.csv", ["2024-01-02T00:00:00Z;5.0;254"])
    put("level_9.csv", ["2024-01-01T00:00:00Z;---;254"])
    go(), slots()
    got = {(r["series_id"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    assert got == {("7", 1.0), ("7", 3.0), ("8", 5.0), ("9", None)}
    go(), slots()
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 4
    closed = spark.read.parquet(f"{tmp_path}/slots").where("series_id = '7'").collect()
    assert [(r["mean"], r["total"], r["n"]) for r in closed] == [(2.0, 4.0, 2)]


@pytest.mark.parametrize("shape", ["one", "ties", "spike"])
def test_quantiles_in_parts_of_the_bracket(spark, shape):
    r = np.random.default_rng(9)
    x = {"one": np.array([3.5]), "ties": np.repeat([1.0, 2.0, 7.0], [20_000, 30_000, 3]), "spike": np.r_[r.normal(0, 1e-9, 40_000), 1e6, -1e6]}[shape]
    df = spark.createDataFrame(pd.DataFrame({"k": None if shape == "one" else "a", "v": x}), "k string, v double")
    probs = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.999, "e": 1.0}
    row = exact_quantiles(df, ["k"], "v", probs).first()
    for name, p in probs.items():
        assert row[name] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-15)
