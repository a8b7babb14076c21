"""Faults found at size: texts that were joined back, long plans, crowded cells, one buffer for a whole column."""

import math
import random
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from rivulet.functions import labels
from rivulet.operators import joins, profiles, scenarios, scores, stats, windows
from rivulet.plans import nearest
from rivulet.plans.quantiles import exact_quantiles
from rivulet.queries import events as event_queries
from rivulet.queries import scenarios as scenario_queries

rng = random.Random(5)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rule_table_moves_no_text(spark):
    """texts joined back on themselves ended in an error ('could not find text') once the join was not a broadcast."""
    texts = spark.createDataFrame([(1, "the river"), (2, "der Fluss"), (3, None), (4, "x"), (5, "the river"), (1, "the river")], "doc_id long, text string")
    rules = labels.rule_table(spark, (("(^| )the( |$)", "English"), ("(^| )der( |$)", "German"), ("river", "late")))
    out = labels.label_by_table(texts, rules, "text", "language", "unknown")
    assert "Join" not in plan(out)
    got = sorted((r.doc_id, r.text or "", r.language) for r in out.collect())
    assert got == [(1, "the river", "English"), (1, "the river", "English"), (2, "der Fluss", "German"), (3, "", "unknown"), (4, "x", "unknown"), (5, "the river", "English")]


def test_timing_scores_do_not_repeat_their_plan(spark):
    """the plan of the errors came back in every pass over them, so the driver held dozens of copies of its joins."""
    marked = spark.range(40).join(spark.range(40).withColumnRenamed("id", "other"), F.col("id") == F.col("other"))
    errors = marked.select((F.col("id") % 2).alias("series_id"), (F.col("id") % 4).alias("window_id"), (F.col("other") * 1.0).alias("abs_error_h"))
    per_window = scenarios.timing_summary(errors, ("series_id", "window_id"))
    out = scores.weighted_timing(per_window, ("series_id",))
    assert "other" not in plan(per_window) and "abs_error_h" not in plan(out)
    got = {r.series_id: (r.n_events, r.timing_mean_h, r.timing_median_h) for r in out.collect()}
    assert got == {0: (20, 19.0, 19.0), 1: (20, 20.0, 20.0)}


def _raster(spark):
    px = [(r, c, float((r * 7 + c * 3) % 11), r + c / 10 if (r + c) % 5 else None) for r in range(40) for c in range(40) if (r * c) % 7 != 3]
    return spark.createDataFrame(px + px[:50] + [(3, 4, None, 1.0)], "row long, col long, hand double, elev double")


def _nodes(spark, n=60):
    rows = [(i, 30.0 * rng.randrange(0, 39) + rng.randrange(0, 7), -30.0 * rng.randrange(0, 39) - rng.randrange(0, 7)) for i in range(n)]
    return spark.createDataFrame(rows + rows[:5] + [(7, 600.0, -600.0), (99, None, 1.0)], "node long, easting double, northing double")


def test_corridors_move_no_samples(spark):
    """60 samples of each pair went through a shuffle to meet their pixels."""
    nodes, px = _nodes(spark), _raster(spark)
    none = spark.createDataFrame([], "src long, dst long")
    plain = joins.corridor_minimum(joins.candidate_pairs(nodes, none, 0.4), px, (0.0, 0.0), (30.0, -30.0))
    dealt = joins.corridor_minimum(joins.candidate_pairs(nodes, none, 0.4, keep_blocks=True), px, (0.0, 0.0), (30.0, -30.0), reach=400.0)
    assert "_k#" in plan(plain) and "_k#" not in plan(dealt)
    rows = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert rows(dealt) == rows(plain) and len(rows(dealt)) > 100
    both = joins.overland_edges(dealt, 1.0).collect()
    assert {(r.src, r.dst) for r in both} == {(r.dst, r.src) for r in both} and both


def test_a_crowded_place_is_dealt_over_blocks(spark):
    """all rows of a cell as wide as the radius met in one task."""
    crowd = spark.createDataFrame([(i, 5.0, 5.0) for i in range(1200)] + [(i, rng.uniform(-90, 90), rng.uniform(-90, 90)) for i in range(1200, 1300)], "i long, x double, y double")
    refs = crowd.select(F.col("i").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"))
    met = nearest.within_radius(crowd, refs, ["x", "y"], ["u", "v"], 20.0, keep_blocks=True)
    most = met.groupBy(*nearest.blocks_of(2)).agg(F.count_distinct("i").alias("p"), F.count_distinct("j").alias("r")).agg(F.max("p"), F.max("r"), F.count("*")).first()
    assert most[0] < 1.3 * nearest.BLOCK[0] and most[1] <= 1.3 * nearest.BLOCK[1] and most[2] > 3
    near = met.where("(x - u) * (x - u) + (y - v) * (y - v) <= 400").agg(F.count("*"), F.count_distinct("i", "j")).first()
    at = [(r.x, r.y) for r in crowd.collect()]
    assert near[0] == near[1] == sum((a - c) ** 2 + (b - d) ** 2 <= 400 for a, b in at for c, d in at)


def test_pairs_near_each_other_are_compared_in_many_tasks(spark, monkeypatch):
    """the bytes of the places, not their pairs, set the number of tasks, and pairs were joined with the edges."""
    rows = [(i, float(rng.randrange(0, 300)), float(rng.randrange(-300, 0))) for i in range(150)] + [(i, 7000.0, 7000.0) for i in range(150, 230)]
    rows += [(i, rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)) for i in range(230, 300)]
    rows += rows[:4] + [(5, 7000.0, 7001.0), (300, 0.0, 8000.0), (301, 0.0, 0.0), (None, 1.0, 1.0), (302, None, 1.0), (303, float("nan"), 1.0), (304, float("inf"), 1.0)]
    ends = [(0, k) for k in range(1, 120, 2)] + [(9, 8), (8, 9), (8, 9), (160, 151), (3, 3), (4, None), (None, 6), (7, 9999)]
    nodes, edges = spark.createDataFrame(rows, "node long, easting double, northing double"), spark.createDataFrame(ends, "src long, dst long")
    known = {(min(e), max(e)) for e in ends if None not in e}
    inside = [r for r in rows if r[0] is not None and r[1] is not None and math.isfinite(r[1])]
    want = sorted(
        (a[0], b[0], round(math.hypot(a[1] - b[1], a[2] - b[2]) / 1000, 9), *a[1:], *b[1:])
        for a in inside for b in inside if a[0] < b[0] and (a[0], b[0]) not in known and math.hypot(a[1] - b[1], a[2] - b[2]) <= 8000)
    monkeypatch.setattr(nearest, "BLOCK", (16, 64))
    for name, value in {"COMPARED": 1 << 10, "SPREAD": 40}.items():
        monkeypatch.setattr(nearest, name, value, raising=False)
    for few in (100_000, 0):  # small tables go to every task or are merged
        monkeypatch.setattr(nearest, "FEW", few, raising=False)
        out = joins.candidate_pairs(nodes, edges, 8.0)
        got = sorted((r.i, r.j, round(r.dist_km, 9), r.e1, r.n1, r.e2, r.n2) for r in out.collect())
        assert got == want and "LeftAnti" not in plan(out)
        most = out.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
        assert most < len(want) / 8


def test_nearest_within_compares_no_crowd(spark):
    """F8: each point was compared with all references in the touching cells."""
    refs = [(i, rng.uniform(0, 40), rng.uniform(0, 40)) for i in range(900)] + [(900 + i, 20.0, 20.0) for i in range(300)]
    points = [(i, rng.uniform(-60, 100), rng.uniform(-60, 100)) for i in range(200)] + [(200, None, 1.0), (3, 21.0, 20.0)]
    p, r = spark.createDataFrame(points, "k long, x double, y double"), spark.createDataFrame(refs, "ref long, x double, y double")
    out = joins.nearest_within(p, r, ("x", "y"), "ref", 15.0, ("k",))
    want = {}
    for k, x, y in points:
        if x is not None:
            d, ref = min((math.hypot(x - a, y - b), i) for i, a, b in refs)
            if d <= 15.0:
                want[k] = min(want.get(k, (d, ref)), (d, ref))
    assert {r.k: (round(r.dist, 9), r.ref) for r in out.collect()} == {k: (round(d, 9), ref) for k, (d, ref) in want.items()}


def test_most_places_are_settled_by_an_even_grid(spark):
    """every place went down the whole tree."""
    refs = spark.createDataFrame([(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(500)], "ref long, u double, v double")
    places = spark.createDataFrame([(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(400)], "x double, y double")
    spots = refs.groupBy("u", "v").agg(F.min(F.struct(F.col("ref").alias("o"), F.col("ref").alias("id"))).alias("_r"))
    dist = F.sqrt((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2)
    hit, rest = nearest._by_grid(places, spots, ["x", "y"], ["u", "v"], dist)
    assert hit.count() + rest.count() == 400 and rest.count() < 40
    out = nearest.nearest(places, refs, ["x", "y"], ["u", "v"], "ref", "ref", dist)
    all_refs = refs.collect()
    assert all(r.ref == min((math.hypot(r.x - q.u, r.y - q.v), q.ref) for q in all_refs)[1] for r in out.collect())


def test_quantiles_of_few_keys_do_not_sort_a_key_in_one_task(spark):
    """brackets were joined by key, so all values of a column were sorted in one task."""
    df = spark.range(2000).select((F.col("id") % 2).alias("k"), (F.col("id") * 1.0).alias("v"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = exact_quantiles(df, ["k"], "v", {"m": 0.5})
        assert "strategy=broadcast" in plan(out)
        assert {r.k: r.m for r in out.collect()} == {0: 999.0, 1: 1000.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_markers_read_their_points_once(spark):
    """the points were made, parsed and dealt out twice and joined."""
    rows = [("a", i, z, m) for i, (z, m) in enumerate([(5.0, True), (3.0, True), (1.0, False), (2.0, False), (4.0, True), (6.0, True)])] + [(None, 0, 1.0, True), ("b", 0, 2.0, True)]
    out = profiles.bankfull_from_markers(spark.createDataFrame(rows, "path string, i int, level double, panel_boundary boolean"), ("path",))
    assert "Join" not in plan(out)
    assert sorted(tuple(r) for r in out.collect() if r.path == "a") == [("a", 1.0, 3.0, 4.0, 6, 3.0, 2.0)]
    assert sorted((r.path, r.bankfull) for r in out.collect()) == [("a", 3.0), ("b", None)]


def test_similarity_copies_no_vector_per_group(spark):
    """each vector went to the disk once per group of vectors."""
    v = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(50)]
    df = spark.createDataFrame([*enumerate(v), (50, None)], "k long, v array<double>")
    out = stats.wetness_similarity(df, "k", "v", block_rows=4)
    assert "explode" not in plan(out)
    got = {(r.a, r.b): r.similarity for r in out.collect()}
    assert len(got) == 51 * 52 // 2 and got[50, 50] == 1.0 and got[3, 50] is None
    c = np.array(v) - np.mean(v, axis=1, keepdims=True)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    assert all(abs(got[a, b] - (c @ c.T)[a, b]) < 1e-12 for a in range(50) for b in range(a, 50))


def _events(spark, steps=260):
    kinds = ("click", "view", "error", "purchase", "signup")
    rows = [(5 * i + j, 15 * i + j, i % 20, k, float((i * (7 + j)) % 23 * 6), '{"k": 5}') for i in range(steps) for j, k in enumerate(kinds) if (i + j) % 9]
    df = spark.createDataFrame(rows, "event_id long, minute int, user_id long, event_type string, value double, props string")
    return df.selectExpr("event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, minute, 0) as ts", "user_id", "event_type", "value", "props")


def test_forecast_pair_is_planned_once(spark):
    """F1 of round 4: every pass over the pair planned the grid, its bounds and the join again on the driver."""
    obs, pred = event_queries.shifted_forecast(SimpleNamespace(events=_events(spark)))
    assert not any(x in plan(df) for x in ("Join", "scalar-subquery") for df in (obs, pred))
    o, p = ({(r.series_id, r.ts): r.value for r in df.collect()} for df in (obs, pred))
    raw = {(r.event_type, r.ts.replace(minute=r.ts.minute // 15 * 15)): r.value for r in _events(spark).collect()}
    assert len(o) == len(p) == 5 * 260 and sum(v is not None for v in o.values()) > 500
    for (k, at), v in o.items():
        late = next((raw[x] for x in raw if x[0] == k and (at - x[1]).total_seconds() == 45 * 60), None)
        want = (raw.get((k, at)), late) if late is not None and (k, at) in raw else (None, None)
        assert v == want[0] and (p[k, at] is None if want[1] is None else abs(p[k, at] - 0.8 * want[1]) < 1e-9)


def test_scenario_record_holds_no_passes_of_its_timing(spark, monkeypatch):
    """F1 of round 4: the window's start was a subquery planned wherever a window is named, and the record's plan held the quantiles of its timing."""
    seen, peaks = [], windows.local_maxima
    monkeypatch.setattr(windows, "local_maxima", lambda df, *a, **b: seen.append(plan(df)) or peaks(df, *a, **b))
    t = SimpleNamespace(events=_events(spark))
    out = scenario_queries.scenario_record(t)
    assert len(seen) == 2 and not any("subquery" in x for x in seen) and "_part#" not in plan(out)
    timing = {r.series_id: (r.timing_mean_h, r.timing_median_h, r.n_events) for r in scenario_queries.window_timing(t).collect()}
    got = out.collect()
    assert len(got) == 5 * 3 * 4 and timing
    assert all((r.peak_timing_mean_hr, r.peak_timing_median_hr, r.peak_timing_n_events) == timing.get(r.scenario, (None, None, 0)) for r in got)


def test_similarity_shuffles_its_vectors_once(spark, monkeypatch):
    """F2 of round 4: vectors were shuffled twice and as doubles before they were written."""
    v = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(40)]
    keys = [*range(38), 3, 3]
    df = spark.createDataFrame([*zip(keys, v), (None, v[0])], "g long, v array<float>")
    seen, cut = [], stats.cut
    monkeypatch.setattr(stats, "cut", lambda d: seen.append(d) or cut(d))
    out = stats.wetness_similarity(df, "g", "v", block_rows=4)
    shuffles = [x for x in seen[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines() if "Exchange" in x]
    assert len(shuffles) == 1 and out.rdd.getNumPartitions() <= 4
    c = np.array(v, "float32").astype(float)
    c -= c.mean(axis=1, keepdims=True)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    pairs = [(i, j) for i in range(40) for j in range(40) if keys[i] <= keys[j]]
    want = sorted((keys[i], keys[j], round(1.0 if keys[i] == keys[j] else (c @ c.T)[i, j], 9)) for i, j in pairs)
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in out.collect()) == want
