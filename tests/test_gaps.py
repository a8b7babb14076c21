"""Peaks beside gaps, timing inside windows, quantile brackets, grid scans, normal tails: against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.operators import comparison, graph, joins, pixels, stats, timegrid, windows
from rivulet.plans import nearest
from rivulet.plans.quantiles import exact_quantiles
from rivulet.plans.timechunks import HOUR


def steps_of(rows, base):
    return sorted(int((r["ts"] - base).total_seconds()) // 900 for r in rows)


def plain_peaks(v):
    """Middles of runs above both neighbours; missing steps are lowest; ends are none."""
    v = [-math.inf if x is None else x for x in v]
    out, i = [], 1
    while i < len(v) - 1:
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if j < len(v) - 1 and v[i] > v[i - 1] and v[i] > v[j + 1]:
            out.append((i + j) // 2)
        i = j + 1
    return out


def plain_thin(peaks, v, apart):
    kept = []
    for p in sorted(peaks, key=lambda p: (v[p], p), reverse=True):
        if all(abs(p - k) >= apart for k in kept):
            kept.append(p)
    return sorted(kept)


def test_values_beside_gaps_can_be_peaks(spark, readings):
    vals = [1, 2, None, 5, 1, 7, 1, 3, None, None, 1]
    df = readings([("s", 15 * i, None if v is None else float(v)) for i, v in enumerate(vals)])
    base = df.agg(F.min("ts")).first()[0]
    assert steps_of(windows.local_maxima(df, F.lit(0.0)).collect(), base) == [1, 3, 5, 7] == plain_peaks(vals)
    holes = df.where("value is not null")  # the same without rows for the gaps
    assert steps_of(windows.local_maxima(holes, F.lit(0.0)).collect(), base) == [1, 3, 5, 7]


def test_timing_equals_a_plain_version(spark, readings):
    rng = random.Random(21)
    n = 1_200
    obs = [None if rng.random() < 0.1 else float(rng.randrange(0, 30)) for _ in range(n)]
    pred = [None if rng.random() < 0.15 or 500 <= i < 1_000 else float(rng.randrange(0, 25)) for i in range(n)]
    pred[700:704] = [1.0, 2.0, 3.0, 4.0]
    frame = lambda v: readings([("s", 15 * i, x) for i, x in enumerate(v)])
    op = windows.thin_peaks(windows.local_maxima(frame(obs), F.lit(27.0)), 4 * HOUR)
    got = windows.peak_timing_error(frame(pred), op).collect()
    base = frame(obs).agg(F.min("ts")).first()[0]
    want = {}
    for p in plain_thin([i for i in plain_peaks(obs) if obs[i] >= 27], obs, 16):
        lo, hi = max(0, p - 192), min(n, p + 192)
        w = pred[lo:hi]
        if all(x is None for x in w):
            continue
        own = plain_thin(plain_peaks(w), w, 16)
        if own:
            want[p] = min((abs(lo + k - p), lo + k - p) for k in own)[1] / 4
        else:
            top = max(x for x in w if x is not None)
            want[p] = (lo + w.index(top) - p) / 4
    assert {int((r["obs_ts"] - base).total_seconds()) // 900: r["error_h"] for r in got} == want


def test_quantiles_use_the_bracket_and_fail_on_a_miss(spark):
    df = spark.range(5_000).selectExpr("cast((id * 7919) % 5000 as double) as v")
    assert exact_quantiles(df, [], "v", {"q": 0.37}, accuracy=100).first()["q"] == pytest.approx(0.37 * 4_999)
    with pytest.raises(Exception, match="outside its bracket"):
        exact_quantiles(df, [], "v", {"q": 0.37}, accuracy=100, slack=-0.05).collect()


def test_grid_reads_raw_rows_once(spark, readings, tmp_path):
    readings([("a", 0, 1.0), ("a", 100, 2.0), ("b", 40, 3.0)]).write.parquet(str(tmp_path / "r"))
    plan = timegrid.regular_grid(spark.read.parquet(str(tmp_path / "r")))._jdf.queryExecution().toString()
    assert "parquet" not in plan.split("== Physical Plan ==")[1].lower()  # only the written slots are read
    assert timegrid.regular_grid(spark.read.parquet(str(tmp_path / "r"))).count() == 14


def test_normal_tail_equals_erfc(spark):
    z = [0.0, 1e-9, 0.5, -1.0, 1.96, 2.9, 3.1, -3.2, 5.0, 12.0, 40.0]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select("z", comparison.two_sided_normal_p(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-9, abs=1e-300)
    assert comparison.two_sided_normal_p(F.lit(None).cast("double")) is not None


def test_correlation_of_given_pairs(spark, readings):
    rng = random.Random(22)
    df = readings([(s, 15 * i, rng.random() if (i + k) % 5 else None) for k, s in enumerate("abc") for i in range(80)])
    full = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in stats.correlation_matrix(df).collect()}
    some = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in stats.correlation_matrix(df, spark.createDataFrame([("a", "c"), ("c", "b"), ("a", "c")], "a string, b string")).collect()}
    assert set(full) == {("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c")} and set(some) == {("a", "c"), ("c", "b")}
    assert some[("a", "c")] == pytest.approx(full[("a", "c")]) and some[("c", "b")] == pytest.approx(full[("b", "c")])


def test_long_paths_and_long_responses_are_whole(spark, readings):
    edges = spark.createDataFrame([(i, i + 1, i) for i in range(14)], "src long, dst long, edge_order long")
    nodes = spark.range(15).withColumnRenamed("id", "node")
    reach = graph.downstream_edges(nodes, edges, max_hops=None)
    assert {r["node"]: r["n_downstream"] for r in graph.criticality(nodes, reach).collect()} == {i: 14 - i for i in range(15)}
    rain = readings([("s", 0, 1.0)])
    params = spark.createDataFrame([("s", 1.0, 8.0)], "series_id string, peak_rate double, tc_hours double")
    got = graph.unit_response(rain, params)
    assert got.count() == 85 and got.agg(F.sum("response")).first()[0] == pytest.approx(42.5)


def test_reach_is_whole_by_default(spark):
    edges = spark.createDataFrame([(i, i + 1, i) for i in range(12)], "src long, dst long, edge_order long")
    sources = spark.createDataFrame([(0,)], "node long")
    assert graph.downstream_edges(sources, edges).count() == 12
    assert graph.downstream_edges(sources, edges, max_hops=8).count() == 8


def test_frames_are_thinned_evenly_or_not_at_all(spark):
    frames = spark.range(191).selectExpr("1L as event_id", "id as ts")
    assert pixels.subsample_frames(frames).count() == 191
    kept = sorted(r["ts"] for r in pixels.subsample_frames(frames, max_frames=96).collect())
    assert len(kept) == 96 and kept[0] == 0 and kept[-1] >= 188 and max(b - a for a, b in zip(kept, kept[1:])) <= 2
