"""Query registry and the tables every query starts from.

The given tables stand in for sensor data. Each stand-in exists twice, as a
DataFrame and as SQL text, and both read the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one scale directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register `fn(tables)` under a name, with its oracle SQL if there is one."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            out = fn(Tables(spark, sf_dir))
            zoned = [f.name for f in out.schema if isinstance(f.dataType, T.TimestampType)]
            return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else out

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def r6(col: Column | str) -> Column:
    """Six digits by the same arithmetic in both engines; the offset sends exact ties and summation noise the same way."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * 1e6 + 0.5001) / 1e6


def s6(expr: str) -> str:
    return f"(floor(({expr}) * 1e6::DOUBLE + 0.5001::DOUBLE) / 1e6::DOUBLE)"


# ---------------------------------------------------------------- readings
KINDS = {"click": "level", "view": "level", "error": "discharge", "purchase": "rainfall", "signup": "rainfall"}


def readings(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind.isin("click", "view"), "level").when(kind == "error", "discharge").otherwise("rainfall")
    return t.events.select(
        kind.alias("series_id"),
        label.alias("kind"),
        "ts",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("quality_code"),
        F.col("event_id").alias("seq"),
        "user_id",
    )


READINGS = """readings AS (
  SELECT event_type AS series_id,
    CASE WHEN event_type IN ('click','view') THEN 'level' WHEN event_type = 'error' THEN 'discharge' ELSE 'rainfall' END AS kind,
    ts, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS quality_code, event_id AS seq, user_id
  FROM events)"""

SLOTS = f"""{READINGS},
slots AS (SELECT series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS value, count(value) AS n FROM readings GROUP BY 1, 2),
axis AS (SELECT unnest(generate_series((SELECT min(ts) FROM slots), (SELECT max(ts) FROM slots), INTERVAL 15 MINUTE)) AS ts),
series AS (SELECT DISTINCT series_id FROM readings),
grid AS (SELECT s.series_id, a.ts, v.value FROM series s CROSS JOIN axis a LEFT JOIN slots v ON v.series_id = s.series_id AND v.ts = a.ts)"""

HOURLY = f"""{READINGS},
slots AS (SELECT series_id, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) AS value, sum(value) AS total FROM readings GROUP BY 1, 2),
axis AS (SELECT unnest(generate_series((SELECT min(ts) FROM slots), (SELECT max(ts) FROM slots), INTERVAL 1 HOUR)) AS ts),
series AS (SELECT DISTINCT series_id FROM readings),
hourly AS (SELECT s.series_id, a.ts, v.value, v.total FROM series s CROSS JOIN axis a LEFT JOIN slots v ON v.series_id = s.series_id AND v.ts = a.ts)"""


def grid(t: Tables, freq: str = "15 minutes") -> DataFrame:
    from rivulet.operators import timegrid

    return timegrid.regular_grid(readings(t), freq=freq)


# ------------------------------------------------------------------- nodes
def nodes(t: Tables) -> DataFrame:
    """Gauges of the network: one per supplier."""
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("node"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("water_"), F.col("s_nationkey")).alias("water_body"),
        (F.lit(50) + F.pmod(k * 37, F.lit(211)) * 0.01).alias("lat"),
        (F.lit(-9) + F.pmod(k * 53, F.lit(197)) * 0.01).alias("lon"),
        (F.lit(500000.0) + F.pmod(k * 7919, F.lit(60013)).cast("double")).alias("easting"),
        (F.lit(560000.0) + F.pmod(k * 104729, F.lit(50021)).cast("double")).alias("northing"),
        (F.abs("s_acctbal") / 10 + 1).alias("area_km2"),
        (F.pmod(k * 13, F.lit(29)) * 0.5).alias("datum"),
        (F.pmod(k * 13, F.lit(29)) * 0.5 + 0.4 + F.pmod(k, F.lit(7)) * 0.3).alias("p90"),
        (F.pmod(k, F.lit(11)) == 3).alias("is_reservoir"),
        (F.pmod(k, F.lit(13)) == 5).alias("is_tidal"),
    )


NODES = """nodes AS (
  SELECT s_suppkey AS node, s_name AS name, 'water_' || s_nationkey AS water_body,
    50 + ((s_suppkey * 37) % 211) * 0.01::DOUBLE AS lat, -9 + ((s_suppkey * 53) % 197) * 0.01::DOUBLE AS lon,
    500000.0::DOUBLE + ((s_suppkey * 7919) % 60013)::DOUBLE AS easting, 560000.0::DOUBLE + ((s_suppkey * 104729) % 50021)::DOUBLE AS northing,
    abs(s_acctbal) / 10 + 1 AS area_km2, ((s_suppkey * 13) % 29) * 0.5::DOUBLE AS datum,
    ((s_suppkey * 13) % 29) * 0.5::DOUBLE + 0.4::DOUBLE + (s_suppkey % 7) * 0.3::DOUBLE AS p90,
    (s_suppkey % 11 = 3) AS is_reservoir, (s_suppkey % 13 = 5) AS is_tidal
  FROM supplier)"""


def edges(t: Tables) -> DataFrame:
    """River edges: every gauge but the outlet drains to gauge floor(k/2)."""
    k = F.col("s_suppkey")
    return t.supplier.where(k >= 1).select(
        k.alias("src"),
        F.floor(k / 2).cast("long").alias("dst"),
        (F.lit(1.0) + F.pmod(k * 7, F.lit(13))).alias("dist_km"),
        (F.pmod(k * 5, F.lit(17)) * 0.7).alias("elev_drop"),
        (F.lit(0.2) + F.pmod(k * 3, F.lit(10)) * 0.15).alias("velocity"),
    )


EDGES = """edges AS (
  SELECT s_suppkey AS src, s_suppkey // 2 AS dst, 1.0::DOUBLE + (s_suppkey * 7) % 13 AS dist_km,
    ((s_suppkey * 5) % 17) * 0.7::DOUBLE AS elev_drop, 0.2::DOUBLE + ((s_suppkey * 3) % 10) * 0.15::DOUBLE AS velocity
  FROM supplier WHERE s_suppkey >= 1)"""


# ---------------------------------------------------------------- forecasts
def forecast(t: Tables) -> DataFrame:
    """Three models' forecasts of every event, scored against the observed value."""
    e = F.col("event_id")
    target = F.col("value") / 50
    pred = (
        F.when(F.col("model") == "m_a", target * 0.9 + 0.05)
        .when(F.col("model") == "m_b", target + (F.pmod(e * 7, F.lit(11)) - 5) * 0.05)
        .otherwise(target * 0.5 + F.pmod(e * 13, F.lit(17)) * 0.03)
    )
    return t.events.withColumn("model", F.explode(F.array(F.lit("m_a"), F.lit("m_b"), F.lit("m_c")))).select(
        "model",
        F.pmod(e, F.lit(2)).alias("seed"),
        F.when(F.pmod(F.floor(e / 2), F.lit(2)) == 0, 4).otherwise(12).alias("horizon"),
        F.col("user_id").alias("node"),
        (F.pmod(F.floor(e / 4), F.lit(4)) + 1).alias("step"),
        "ts",
        e.alias("row_id"),
        pred.alias("pred"),
        target.alias("target"),
        (F.get_json_object("props", "$.k").cast("int") >= 10).alias("valid"),
    )


FORECAST = """forecast AS (
  SELECT m.model, e.event_id % 2 AS seed, CASE WHEN (e.event_id // 2) % 2 = 0 THEN 4 ELSE 12 END AS horizon,
    e.user_id AS node, (e.event_id // 4) % 4 + 1 AS step, e.ts, e.event_id AS row_id,
    CASE m.model WHEN 'm_a' THEN e.value / 50 * 0.9::DOUBLE + 0.05::DOUBLE
      WHEN 'm_b' THEN e.value / 50 + ((e.event_id * 7) % 11 - 5) * 0.05::DOUBLE
      ELSE e.value / 50 * 0.5::DOUBLE + ((e.event_id * 13) % 17) * 0.03::DOUBLE END AS pred,
    e.value / 50 AS target, CAST(json_extract_string(e.props, '$.k') AS INTEGER) >= 10 AS valid
  FROM events e CROSS JOIN (VALUES ('m_a'), ('m_b'), ('m_c')) m(model))"""


# ------------------------------------------------------------------- pixels
RASTER_WIDTH = 128


def pixels(t: Tables) -> DataFrame:
    """A raster of one pixel per order, 128 columns wide: elevation falls towards the origin."""
    k = F.col("o_orderkey")
    row, col = F.floor(k / RASTER_WIDTH), F.pmod(k, F.lit(RASTER_WIDTH))
    return t.orders.select(
        row.alias("row"),
        col.alias("col"),
        (row * 1.0 + col * 0.5 + F.col("o_totalprice") / 100000).alias("elev"),
        (F.pmod(F.col("o_custkey") * 7 + col * 3, F.lit(60)) * 0.1).alias("hand"),
        (F.lit(-20.0) + F.pmod(F.col("o_custkey") * 11 + row, F.lit(97)) * 0.15).alias("sigma0"),
        (F.lit(-18.0) + F.pmod(F.col("o_custkey") * 5 + col, F.lit(89)) * 0.13).alias("sigma0_ref"),
        F.col("o_custkey").alias("tag"),
    )


PIXELS = """pixels AS (
  SELECT o_orderkey // 128 AS "row", o_orderkey % 128 AS col,
    (o_orderkey // 128) * 1.0::DOUBLE + (o_orderkey % 128) * 0.5::DOUBLE + o_totalprice / 100000 AS elev,
    ((o_custkey * 7 + (o_orderkey % 128) * 3) % 60) * 0.1::DOUBLE AS hand,
    -20.0::DOUBLE + ((o_custkey * 11 + o_orderkey // 128) % 97) * 0.15::DOUBLE AS sigma0,
    -18.0::DOUBLE + ((o_custkey * 5 + o_orderkey % 128) % 89) * 0.13::DOUBLE AS sigma0_ref, o_custkey AS tag
  FROM orders)"""


def flood_labels(t: Tables) -> DataFrame:
    """Predicted and observed wet flags per pixel."""
    return pixels(t).select(
        "row", "col", (F.col("hand") <= 2.0).alias("pred"), (F.pmod(F.col("tag") + F.col("row"), F.lit(3)) == 0).alias("obs"),
        (F.pmod(F.col("tag"), F.lit(10)) != 0).alias("mask"), (1 - F.col("hand") / 6).alias("prob"),
    )


FLOOD_LABELS = f"""{PIXELS},
labels2 AS (SELECT "row", col, hand <= 2.0 AS pred, (tag + "row") % 3 = 0 AS obs, tag % 10 <> 0 AS mask, 1 - hand / 6 AS prob FROM pixels)"""
