"""Edge rules of single operators on tiny hand-made tables."""

from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from rivulet.functions import expr as X
from rivulet.functions import labels as L
from rivulet.operators import comparison, quality, scores, stats, timegrid, windows
from rivulet.plans.timechunks import HOUR
from rivulet.sources import ingest


def minutes(df, col="ts"):
    return [(r[col].day - 1) * 1440 + r[col].hour * 60 + r[col].minute for r in df.collect()]


def test_empty_inner_slot_zero_or_null(readings):
    df = readings([("a", 0, 1.0), ("a", 30, 2.0), ("b", 60, 5.0)])
    own = timegrid.resample_own_span(df, "15 minutes").orderBy("series_id", "ts").collect()
    assert [(r["series_id"], r["value"]) for r in own] == [("a", 1.0), ("a", 0.0), ("a", 2.0), ("b", 5.0)]
    full = timegrid.regular_grid(df, how="sum").where("series_id = 'a'").orderBy("ts").collect()
    assert [r["value"] for r in full] == [1.0, None, 2.0, None, None]


def test_gap_of_exactly_the_limit_and_trailing_gap(readings):
    rows = [("a", 15 * i, None if 2 <= i < 26 else 1.0) for i in range(28)] + [("b", 15 * i, 1.0 if i < 3 else None) for i in range(28)]
    gaps = {r["series_id"]: r["duration_hours"] for r in quality.find_gaps(readings(rows), 6.0).collect()}
    assert gaps == {"a": 6.0, "b": 6.0}  # b ends at the last step of the grid
    assert quality.find_gaps(readings(rows), 6.01).count() == 0


def test_fill_limit_six_then_zero(readings):
    rows = [("a", 15 * i, 7.0 if i == 0 else None) for i in range(9)]
    got = [r["filled"] for r in windows.forward_fill(readings(rows), "value").orderBy("ts").collect()]
    assert got == [7.0] * 7 + [0.0, 0.0]


def test_duplicate_timestamps_keep_the_first(readings):
    df = readings([("a", 0, 2.0, 2), ("a", 0, 1.0, 1), ("a", 15, 3.0, 3)], "series_id string, minute int, value double, seq int")
    assert sorted(r["value"] for r in quality.first_per_timestamp(df, "seq").collect()) == [1.0, 3.0]


def test_anomaly_frame_excludes_its_left_edge(readings):
    rows = [("a", 0, 100.0), ("a", 7 * 1440 - 15, 1.0), ("a", 7 * 1440, 3.0)]
    got = {m: r for m, r in zip(minutes(readings(rows)), [0, 0, 0])}
    assert got
    last = windows.stage_anomaly(readings(rows)).orderBy(F.desc("ts")).first()
    assert last["stage_anomaly"] == pytest.approx(3.0 - 2.0)


def test_open_event_dropped_or_kept(readings):
    rows = [("a", 15 * i, v) for i, v in enumerate([0, 5, 6, 0, 5, 5])]
    df = readings([(s, m, float(v)) for s, m, v in rows])
    closed = windows.threshold_events(df, F.lit(1.0)).collect()
    assert [(r["duration_h"], r["peak"], r["excess"]) for r in closed] == [(0.5, 6.0, 5.0)]
    assert windows.threshold_events(df, F.lit(1.0), keep_open=True).count() == 2


def test_event_of_exactly_six_hours_and_fallback(readings):
    rows = [("a", 15 * i, 1.0 if 4 <= i < 28 else 0.0) for i in range(40)]
    assert windows.area_events(readings(rows), 0.3, 6.0).count() == 1
    short = [("a", 15 * i, 1.0 if 4 <= i < 27 else 0.0) for i in range(40)]
    e = windows.most_severe_event(readings(short), 0.3, 6.0).collect()
    assert len(e) == 1 and e[0]["peak"] == 1.0
    assert minutes(windows.most_severe_event(readings(short), 0.3, 6.0), "start") == [0]


def test_nearest_alignment_tie_takes_the_later(readings):
    src = readings([("x", 0, 1.0), ("x", 60, 2.0), ("x", 300, 9.0)]).select("ts", "value")
    tgt = readings([("x", m, 0.0) for m in (30, 45, 120, 121)]).select("ts")
    got = {m: v for m, v in zip(minutes(timegrid.align_nearest(tgt, src, HOUR).orderBy("ts")), [r["value"] for r in timegrid.align_nearest(tgt, src, HOUR).orderBy("ts").collect()])}
    assert got == {30: 2.0, 45: 2.0, 120: 2.0, 121: None}


def test_thresholds_few_readings_and_single_year(spark):
    days = spark.range(0, 366).selectExpr("'full' as series_id", "timestamp_ntz '2024-01-01' + make_dt_interval(cast(id as int)) as ts", "cast(id as double) as value")
    few = spark.range(0, 99).selectExpr("'few' as series_id", "timestamp_ntz '2023-01-01' + make_dt_interval(cast(id as int)) as ts", "cast(id as double) as value")
    got = {r["series_id"]: r for r in stats.flood_thresholds(days.unionByName(few), slots_per_day=1).collect()}
    assert got["few"]["p75"] is None and got["few"]["n_years_used"] == 0
    assert got["full"]["n_years_used"] == 1 and got["full"]["amax_med"] is None and got["full"]["amax_high"] == 365.0


def test_scores_constant_target_and_small_nodes(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0, True)] * 12 + [("s", 1.0, 2.0, True)] + [("v", float(i), float(i), i != 3) for i in range(12)], "node string, pred double, target double, valid boolean")
    n = {r["node"]: r for r in scores.node_scores(df, ["node"]).collect()}
    assert n["s"]["rmse"] is None and n["s"]["n_valid"] == 0
    assert n["v"]["nse"] == 1.0 and n["v"]["n_valid"] == 11
    assert n["c"]["nse"] == pytest.approx(1 - 12 / 1e-8)
    k = {r["node"]: r for r in scores.kge(df, ["node"]).collect()}
    assert k["c"]["kge"] is None and k["s"]["r"] is None and k["v"]["kge"] == pytest.approx(1.0)
    p = scores.pod_far(df.withColumn("m", F.lit(1)), ["m"], F.lit(100.0)).first()
    assert (p["pod"], p["far"]) == (0.0, 0.0)


def test_wilcoxon_against_hand_computation(spark):
    d = [1.0, -2.0, 2.0, 3.0, 0.0, 4.0, -1.0, 5.0, 6.0, 7.0]
    rows = [("m1", i, 10.0 + x) for i, x in enumerate(d)] + [("m2", i, 10.0) for i in range(len(d))]
    df = spark.createDataFrame(rows, "model string, node int, nse double").withColumn("horizon", F.lit(4))
    r = comparison.wilcoxon(df, (("m1", "m2"),), ("horizon",), ("node",)).first()
    # |d| ranks: 1,1 -> 1.5 each; 2,2 -> 3.5 each; 3..7 -> 5..9
    assert (r["n_pairs"], r["n"], r["r_plus"], r["r_minus"]) == (10, 9, 1.5 + 3.5 + 5 + 6 + 7 + 8 + 9, 1.5 + 3.5)
    var = 9 * 10 * 19 / 24 - (6 + 6) / 48
    assert r["z"] == pytest.approx((5.0 - 22.5) / var**0.5)
    assert r["p"] == pytest.approx(2 * NormalDist().cdf((5.0 - 22.5) / var**0.5))
    assert r["winner"] == "m1"


def test_overlapping_outages_count_once(spark, readings):
    df = readings([("n", m, 1.0) for m in (0, 10, 20, 30, 40)]).withColumnRenamed("series_id", "node")
    at = "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, {}, 0)"
    o = spark.sql(f"select 'n' as node, {at.format(10)} as start, {at.format(25)} as end union all select 'n', {at.format(15)}, {at.format(30)}")
    got = quality.mask_outages(df, o, ("value",)).orderBy("ts").collect()
    assert [r["masked"] for r in got] == [False, True, True, False, False]
    assert [r["value"] for r in got] == [1.0, None, None, 1.0, 1.0]


def test_reading_files(spark, tmp_path):
    (tmp_path / "level_19001.csv").write_text("#station;Old Mill\n#unit;m\n2023-01-01T00:00:00.000Z;1.234;254\n2023-01-01T00:15:00.000Z;x;\nbad;1;2\n2023-01-01T00:30:00.000Z;2.5;99;extra\n")
    lines = ingest.read_lines(spark, str(tmp_path))
    rows = ingest.parse_readings(lines, "level").orderBy("ts").collect()
    assert [(r["series_id"], r["value"], r["quality_code"]) for r in rows] == [("19001", 1.234, 254), ("19001", None, 0), ("19001", 2.5, 99)]
    head = {r["key"]: r["val"] for r in ingest.parse_header(lines).collect()}
    assert head == {"station": "Old Mill", "unit": "m"}


def test_section_and_station_files(spark, tmp_path):
    pts = "\n".join(["0 5.0 0.03 0 1 2", "1 4.0 0.03* 0 1 2", "2 1.0 0.03 0 1 2", "3 3.5 0.03* 0 1 2", "4 6 x"])
    (tmp_path / "r.dat").write_text(f"title\nSECTION\nA1\n12.5\n5\n{pts}\nSECTION\nbroken\nnot a number\n1\n0 0 0 0 0 0\n")
    got = ingest.parse_sections(ingest.read_blocks(spark, str(tmp_path / "r.dat"), "SECTION\n"))
    assert sorted((r["section"], r["i"], r["level"], r["panel_boundary"]) for r in got.collect()) == [("A1", 0, 5.0, False), ("A1", 1, 4.0, True), ("A1", 2, 1.0, False), ("A1", 3, 3.5, True)]
    from rivulet.operators.profiles import bankfull_from_markers

    b = bankfull_from_markers(got, ("section",)).first()
    assert (b["thalweg"], b["left_bank"], b["right_bank"], b["bankfull"]) == (1.0, 4.0, 3.5, 3.5)
    dash = "-" * 41 + "\n"
    (tmp_path / "s.txt").write_text(f"Station Number\t19056\nStation Name\tBally\n{dash}Station Number\t19055\n{dash}")
    st = ingest.parse_station_blocks(ingest.read_blocks(spark, str(tmp_path / "s.txt"), dash), {"Station Number": "ref", "Station Name": "name"})
    assert sorted((r["ref"], r["name"]) for r in st.collect()) == [("19055", None), ("19056", "Bally")]


def test_text_rules(spark):
    df = spark.createDataFrame([("1,435,271", "Type II + unknown"), ("11, 7", None), ("Dynamic", "Type I")], "size string, kind string")
    got = df.select(L.graph_size(F.col("size")).alias("s"), L.constraint_components(F.col("kind")).alias("c")).collect()
    assert [r["s"] for r in got] == [1435271.0, 11.0, None]
    assert [r["c"] for r in got] == [["Physical Topology (structural prior)"], ["No Constraint"], ["Physics Loss Constraint"]]
    num = spark.createDataFrame([("3.65 km²",), ("none",)], "t string").select(X.number_in_text(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in num] == [3.65, None]


def test_row_order_and_partitioning_do_not_matter(readings):
    rows = [("a", 15 * i, float((i * 7) % 11)) for i in range(60)]
    one = windows.threshold_events(readings(rows), F.lit(5.0)).collect()
    two = windows.threshold_events(readings(rows[::-1]).repartition(7), F.lit(5.0)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_climatology_wraps_and_handles_leap_day(spark):
    df = spark.range(0, 731).selectExpr("'a' as series_id", "timestamp_ntz '2023-01-01' + make_dt_interval(cast(id as int)) as ts", "1.0 as v").withColumn("value", F.col("v").cast("double"))
    got = windows.climatology_anomaly(df)
    assert got.count() == 731
    assert got.where("abs(anomaly) > 1e-12").count() == 0 and got.where("doy = 366").count() == 1
