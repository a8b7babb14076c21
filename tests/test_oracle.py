"""Registered queries against their SQL on the smallest tables; RIVULET_ALL=1 runs every one."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = (
    "e3_e4_gauge_features", "c7_quality_report", "c21_mask_outages", "d5_align_nearest_hourly", "d16_select_windows", "e7_threshold_events", "e15_exceedance_curve", "e18_estimate_bankfull",
    "j1_nearest_rain_gauge", "j12_products_near_peaks", "j15_alert_scores", "k1_flood_thresholds", "k9_node_scores", "k23_wilcoxon_statistic", "k38_outage_scores", "k44_correlation_matrix",
    "k46_routing_lags", "g1_shortest_distances", "g4_downstream_edges", "g11_hand", "g18_drop_small_patches", "g19_inundated_area", "a9_result_tree", "a18_registry_upsert", "b14_b15_constraint_components",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("RIVULET_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{ROOT}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, ROOT)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr(tuple(dict(zip(cols, r))[c] for c in sorted(cols))) for r in cur.fetchall())
    got = sorted(repr(tuple(r[c] for c in sorted(cols))) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("score", ("event_score", "best_windows", "outage_score", "release_score", "blockage_score"))
def test_scores_of_all_series(spark, con, score):
    name = f"e21_{score}_all"
    test_matches_sql(spark, con, name)
    df, one = entry.queries()[name](spark, ROOT), entry.queries()[f"e21_{score}"](spark, ROOT)
    if score == "best_windows":
        assert df.selectExpr("max(score)").first()[0] >= one.selectExpr("max(score)").first()[0]
    else:
        assert {r[0] for r in df.select("series_id").collect()} == {r[0] for r in con.execute("select distinct event_type from events").fetchall()}
    if score in ("event_score", "outage_score"):
        series = {"event_score": "click", "outage_score": "view"}[score]
        assert sorted(df.where(F.col("series_id") == series).drop("series_id").collect()) == sorted(one.collect())


def test_every_query_name_is_unique_and_checked():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert {n for n in set(q) - set(o) if not re.match(r"op\d+_|pipeline$", n)} == set()  # the optional ones have tests of their own


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"series_id", "ts", "stage_anomaly", "target", "valid"} <= set(df.columns)
