"""Thresholds, normalisation, correlation and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import stats, timegrid, windows
from rivulet.plans.timechunks import HOUR
from rivulet.sources import ingest, sinks

from .base import EDGES, HOURLY, NODES, READINGS, SLOTS, edges, grid, nodes, query, r6, readings, s6


def _round(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


DAILY = """daily AS (SELECT o_orderpriority AS series_id, o_orderdate AS ts, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"""


def daily(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("value"))


THR = f"""{DAILY}, y0 AS (SELECT series_id, CAST(year(ts) AS INTEGER) AS y, count(value) AS n, max(value) AS amax FROM daily GROUP BY 1, 2),
yr AS (SELECT *, n / CASE WHEN (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 THEN 366 ELSE 365 END >= 0.68 AS used FROM y0),
th AS (SELECT series_id, CAST(sum(n) AS BIGINT) AS n_readings, count(*) FILTER (WHERE used) AS ny, median(amax) FILTER (WHERE used) AS med, max(amax) FILTER (WHERE used) AS high, coalesce(string_agg(CAST(y AS VARCHAR), ', ' ORDER BY y) FILTER (WHERE NOT used), '') AS dropped FROM yr GROUP BY 1),
q AS (SELECT series_id, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.90) AS p90 FROM daily GROUP BY 1)"""


@query(
    "k1_flood_thresholds",
    f"""WITH {THR} SELECT series_id, n_readings, 1.0::DOUBLE AS pct_valid, {s6('p75')} AS p75, {s6('p90')} AS p90, ny AS n_years_used,
  CASE WHEN ny >= 2 THEN {s6('med')} END AS amax_med, {s6('high')} AS amax_high, dropped AS partial_years_dropped FROM th JOIN q USING (series_id)""",
)
def flood_thresholds(t):
    out = stats.flood_thresholds(daily(t), slots_per_day=1, min_year_frac=0.68)
    return _round(out, "p75", "p90", "amax_med", "amax_high")


@query("k2_low_record", f"WITH {THR} SELECT series_id, ny AS n_years_used FROM th WHERE ny < 6")
def low_record(t):
    return stats.low_record(stats.flood_thresholds(daily(t), slots_per_day=1, min_year_frac=0.68), 6).select("series_id", "n_years_used")


@query(
    "k3_write_back",
    f"""WITH {THR}, st AS (SELECT DISTINCT o_orderpriority AS series_id, 1.5::DOUBLE AS warn_level, 2.5::DOUBLE AS flood_level FROM orders UNION ALL SELECT 'ungauged', 1.0::DOUBLE, 2.0::DOUBLE)
SELECT series_id, {s6('coalesce(p75, warn_level)')} AS warn_level, {s6('coalesce(p90, flood_level)')} AS flood_level FROM st LEFT JOIN q USING (series_id)""",
)
def write_back(t):
    st = t.orders.select(F.col("o_orderpriority").alias("series_id")).distinct().select("series_id", F.lit(1.5).alias("warn_level"), F.lit(2.5).alias("flood_level"))
    st = st.unionByName(t.spark.range(1).select(F.lit("ungauged").alias("series_id"), F.lit(1.0).alias("warn_level"), F.lit(2.0).alias("flood_level")))
    thr = stats.flood_thresholds(daily(t), slots_per_day=1, min_year_frac=0.68)
    return _round(stats.write_back(st, thr, "series_id", {"warn_level": "p75", "flood_level": "p90"}), "warn_level", "flood_level")


@query(
    "k3_write_back_files",
    f"""WITH {THR}, st AS (SELECT DISTINCT o_orderpriority AS series_id, 1.5::DOUBLE AS warn_level, 2.5::DOUBLE AS flood_level FROM orders UNION ALL SELECT 'ungauged', 1.0::DOUBLE, 2.0::DOUBLE)
SELECT series_id, {s6('coalesce(p75, warn_level)')} AS warn_level, {s6('coalesce(p90, flood_level)')} AS flood_level FROM st LEFT JOIN q USING (series_id)""",
)
def write_back_files(t):
    """The station table in storage, in partitions by the first character of the name; only those with a new threshold are rewritten."""
    st = t.orders.select(F.col("o_orderpriority").alias("series_id")).distinct().select("series_id", F.lit(1.5).alias("warn_level"), F.lit(2.5).alias("flood_level"))
    st = st.unionByName(t.spark.range(1).select(F.lit("ungauged").alias("series_id"), F.lit(1.0).alias("warn_level"), F.lit(2.0).alias("flood_level"))).withColumn("zone", F.ascii("series_id"))
    path = ingest.shared_scratch(t.spark, "station-table")
    sinks.write_partitioned(st, path, ["zone"])
    thr = stats.flood_thresholds(daily(t), slots_per_day=1, min_year_frac=0.68)
    gauged = st.join(thr.where("p75 is not null").select("series_id"), "series_id", "left_semi")
    ingest.upsert_partitions(t.spark, path, stats.write_back(gauged, thr, "series_id", {"warn_level": "p75", "flood_level": "p90"}), ["zone"], "series_id", "series_id")
    return _round(t.spark.read.parquet(path).drop("zone"), "warn_level", "flood_level")


@query(
    "k4_bankfull_fallback",
    f"""WITH tr AS (SELECT o_custkey AS node, o_totalprice / 400000 AS value FROM orders), m AS (SELECT node, max(value) AS mx, quantile_cont(value, 0.99) AS p99 FROM tr GROUP BY 1),
fl AS (SELECT c_custkey AS node, c_custkey % 7 = 0 AS special FROM customer), b AS (SELECT node, special, mx, CASE WHEN mx IS NULL THEN 0.1::DOUBLE ELSE greatest(least(mx * 1.3, p99 * 2), 0.05) END AS b FROM fl LEFT JOIN m USING (node))
SELECT node, {s6('greatest(CASE WHEN special THEN least(b * 1.5, 2) ELSE b END, 0.05)')} AS bankfull, coalesce(mx >= (SELECT quantile_cont(mx, 0.10) FROM m), false) AS reliable FROM b""",
)
def bankfull_fallback(t):
    train = t.orders.select(F.col("o_custkey").alias("node"), (F.col("o_totalprice") / 400000).alias("value"))
    flags = t.customer.select(F.col("c_custkey").alias("node"), (F.pmod("c_custkey", F.lit(7)) == 0).alias("special"))
    return _round(stats.bankfull_fallback(train, flags, "node"), "bankfull")


@query(
    "k5_node_velocity",
    f"""WITH {NODES}, g AS (SELECT l_suppkey AS node, l_quantity AS stage, l_extendedprice / 30000 AS v, 25 + l_suppkey % 20 AS thr FROM lineitem),
a AS (SELECT node, count(*) AS n, count(*) FILTER (WHERE stage > thr AND v <= 3) AS nf, median(v) FILTER (WHERE stage > thr AND v <= 3) AS vf, median(v) AS va FROM g GROUP BY 1),
m AS (SELECT nodes.node, CASE WHEN n >= 3 THEN coalesce(CASE WHEN nf >= 2 THEN vf END, va) END AS v FROM nodes LEFT JOIN a USING (node))
SELECT node, CASE WHEN v > 0.01 AND v < 5 THEN {s6('v')} ELSE 0.8::DOUBLE END AS velocity, CASE WHEN v > 0.01 AND v < 5 THEN 'gaugings' ELSE 'default' END AS source FROM m""",
)
def node_velocity(t):
    g = t.lineitem.select(F.col("l_suppkey").alias("node"), F.col("l_quantity").alias("stage"), (F.col("l_extendedprice") / 30000).alias("velocity"))
    n = nodes(t).select("node", (25 + F.pmod("node", F.lit(20))).alias("bankfull"), F.lit(0.8).alias("default_velocity"))
    return _round(stats.node_velocity(g, n), "velocity")


@query(
    "k6_robust_zscore",
    f"""WITH e AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x FROM lineitem), s AS (SELECT median(CASE WHEN x < 60000 THEN x END) AS m, stddev_pop(CASE WHEN x < 60000 THEN x END) AS sd FROM e)
SELECT l_orderkey, l_linenumber, {s6('((CASE WHEN x < 60000 THEN x ELSE m END) - m) / sd')} AS z FROM e, s""",
)
def robust_zscore(t):
    e = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_extendedprice") < 60000, F.col("l_extendedprice")).otherwise(float("inf")).alias("x"))
    return _round(stats.robust_zscore(e, "x", "z").drop("x"), "z")


@query(
    "k6_norm_stats",
    f"""WITH x AS (SELECT unnest(['quantity', 'price']) AS feature, unnest([l_quantity, l_extendedprice]) AS v FROM lineitem) SELECT feature, {s6('stddev_pop(v)')} AS std, min(v) AS min, max(v) AS max, {s6('median(v)')} AS median FROM x GROUP BY 1""",
)
def norm_stats(t):
    df = t.lineitem.select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return _round(stats.norm_stats(df, ("quantity", "price")), "std", "median")


@query("k7_zscore_sample", f"WITH {EDGES}, s AS (SELECT avg(dist_km) AS md, stddev_samp(dist_km) AS sd, avg(elev_drop) AS me, stddev_samp(elev_drop) AS se FROM edges) SELECT src, dst, {s6('(dist_km - md) / greatest(sd, 1e-6)')} AS dist_km, {s6('(elev_drop - me) / greatest(se, 1e-6)')} AS elev_drop FROM edges, s")
def zscore_sample(t):
    return _round(stats.zscore_sample(edges(t).select("src", "dst", "dist_km", "elev_drop"), ("dist_km", "elev_drop")), "dist_km", "elev_drop")


@query(
    "k44_correlation_matrix",
    f"WITH {SLOTS} SELECT x.series_id AS a, y.series_id AS b, count(*) AS n, {s6('corr(x.value, y.value)')} AS corr FROM slots x JOIN slots y ON x.ts = y.ts AND x.series_id <= y.series_id GROUP BY 1, 2",
)
def correlation_matrix(t):
    return _round(stats.correlation_matrix(timegrid.resample(readings(t))), "corr")


LAGC = f"""{HOURLY},
rain AS (SELECT series_id, ts, coalesce(total, 0) AS v FROM hourly WHERE series_id IN (SELECT series_id FROM readings WHERE kind = 'rainfall')),
lvl AS (SELECT series_id, ts, coalesce(value - lag(value) OVER (PARTITION BY series_id ORDER BY ts), 0) AS v FROM hourly WHERE series_id IN (SELECT series_id FROM readings WHERE kind = 'level')),
z AS (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-9) AS z, count(*) OVER w AS n FROM (SELECT * FROM rain UNION ALL SELECT * FROM lvl) WINDOW w AS (PARTITION BY series_id)),
cur AS (SELECT r.series_id AS a, w.series_id AS b, CAST(w.i - r.i AS INTEGER) AS lag, sum(r.z * w.z) / any_value(w.n) AS xcorr FROM z r JOIN z w ON w.i BETWEEN r.i AND r.i + 72 WHERE r.series_id IN (SELECT series_id FROM rain) AND w.series_id IN (SELECT series_id FROM lvl) GROUP BY 1, 2, 3)"""


def _lag_curve(t):
    """Every rain series against every level series; both share one axis, the grid of all series."""
    hourly = grid(t, "1 hour")
    of_kind = lambda kind, name: readings(t).where(F.col("kind") == kind).select(F.col("series_id").alias(name)).distinct()
    totals = timegrid.resample(readings(t).where("kind = 'rainfall'"), "1 hour", "sum")
    rain = hourly.select("series_id", "ts").join(of_kind("rainfall", "series_id"), "series_id", "left_semi").join(totals, ["series_id", "ts"], "left")
    rain = rain.withColumn("value", F.coalesce("value", F.lit(0.0)))
    change = windows.over_time(hourly.join(of_kind("level", "series_id"), "series_id", "left_semi"), ("series_id",), "ts", lambda w: {"d": F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0))}, before=HOUR)
    change = change.select("series_id", "ts", F.col("d").alias("value"))
    pairs = of_kind("rainfall", "a").crossJoin(of_kind("level", "b"))  # the pairs are what is asked for
    return stats.lag_correlation(rain, change, pairs, 72, HOUR)


@query("k45_lag_correlation", f"WITH {LAGC} SELECT a, b, lag, {s6('xcorr')} AS xcorr FROM cur")
def lag_correlation(t):
    return _round(_lag_curve(t), "xcorr")


@query("k45_peak_lag", f"WITH {LAGC} SELECT a, b, arg_max(lag, {{'x': xcorr, 'l': -lag}}) AS peak_lag, {s6('max(xcorr)')} AS peak_corr FROM cur GROUP BY 1, 2")
def peak_lag(t):
    return _round(stats.peak_lag(_lag_curve(t)), "peak_corr")


CHAIN = """sh AS (SELECT series_id, ts, value FROM grid UNION ALL SELECT series_id || '_down', ts + INTERVAL 45 MINUTE, value FROM grid)"""


@query(
    "k46_routing_lags",
    f"""WITH {SLOTS}, {CHAIN}, m AS (SELECT series_id, avg(value) AS mv FROM sh GROUP BY 1), c AS (SELECT s.series_id, s.ts, s.value AS raw, s.value - m.mv AS v FROM sh s JOIN m USING (series_id) WHERE s.value IS NOT NULL),
pr AS (SELECT DISTINCT series_id AS a, series_id || '_down' AS b FROM grid), bo AS (SELECT p.a, p.b, x.ts, epoch_us(x.ts) // 900000000 AS i, x.v AS va, y.v AS vb, x.raw FROM pr p JOIN c x ON x.series_id = p.a JOIN c y ON y.series_id = p.b AND y.ts = x.ts),
st AS (SELECT a, b, count(*) AS n, stddev_pop(va) AS sa, stddev_pop(vb) AS sb, quantile_cont(raw, 0.8) AS p80 FROM bo GROUP BY 1, 2), hi AS (SELECT bo.a, bo.b, count(*) FILTER (WHERE raw > p80) AS nh FROM bo JOIN st USING (a, b) GROUP BY 1, 2),
lg AS (SELECT x.a, x.b, CAST(y.i - x.i AS INTEGER) AS lag, sum(x.va * y.vb) AS s FROM bo x JOIN bo y ON x.a = y.a AND x.b = y.b AND y.i BETWEEN x.i - 48 AND x.i + 48 GROUP BY 1, 2, 3),
pk AS (SELECT a, b, arg_max(lag, {{'s': s, 'l': -lag}}) AS lag, max(s) AS s FROM lg GROUP BY 1, 2), r AS (SELECT a, b, n, lag, s / (sa * sb * n + 1e-8) AS cr, nh FROM st JOIN pk USING (a, b) JOIN hi USING (a, b))
SELECT a, b, n AS n_valid, lag AS best_lag, {s6('cr')} AS best_corr, CASE WHEN n >= 500 AND nh >= 12 AND cr > 0.4 AND lag > 0 THEN lag END AS empirical_lag FROM r""",
)
def routing_lags(t):
    """Each series against a copy of itself 45 minutes downstream."""
    g = grid(t).select("series_id", "ts", "value")
    down = g.select(F.concat("series_id", F.lit("_down")).alias("series_id"), F.expr("ts + interval 45 minutes").alias("ts"), "value")
    pairs = readings(t).select(F.col("series_id").alias("a"), F.concat("series_id", F.lit("_down")).alias("b")).distinct()
    return _round(stats.routing_lags(g.unionByName(down), pairs, min_corr=0.4), "best_corr")


@query(
    "k47_merge_lags",
    f"""WITH {EDGES}, k AS (SELECT src, dst, greatest(1, CAST(round(dist_km * 1000 / (5.0::DOUBLE / 3 * velocity) / 900) AS INTEGER)) AS kl, CASE WHEN src % 4 = 0 THEN CAST(src % 9 + 1 AS INTEGER) END AS el FROM edges)
SELECT src, dst, coalesce(el, kl) AS lag_steps, CASE WHEN el IS NULL THEN 'kinematic' ELSE 'empirical' END AS source FROM k""",
)
def merge_lags(t):
    e = edges(t)
    kin = e.select("src", "dst", F.greatest(F.lit(1), F.round(F.col("dist_km") * 1000 / (F.lit(5 / 3) * F.col("velocity")) / 900).cast("int")).alias("kinematic_lag"))
    emp = e.where(F.pmod("src", F.lit(4)) == 0).select("src", "dst", (F.pmod("src", F.lit(9)) + 1).cast("int").alias("empirical_lag"))
    return stats.merge_lags(emp, kin)


VEC = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), c AS (SELECT vec_id, list_transform(v, lambda x: x - list_avg(v)) AS v FROM v)"""
SIM = "least(greatest(list_inner_product(x.v, y.v) / greatest(sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v)), 1e-12), -1), 1)"


@query("k54_wetness_similarity", f"WITH {VEC} SELECT x.vec_id AS a, y.vec_id AS b, CASE WHEN x.vec_id = y.vec_id THEN 1.0::DOUBLE ELSE {s6(SIM)} END AS similarity FROM c x JOIN c y ON x.vec_id <= y.vec_id")
def wetness_similarity(t):
    return _round(stats.wetness_similarity(t.embeddings, "vec_id", "embedding"), "similarity")


@query("k54_similar_pairs", f"WITH {VEC} SELECT x.vec_id AS a, y.vec_id AS b, {s6(SIM)} AS similarity FROM c x JOIN c y ON x.vec_id < y.vec_id WHERE {SIM} >= 0.4")
def similar_pairs(t):
    """The pairs above a similarity, which is what is asked of the matrix."""
    return _round(stats.similar_pairs(t.embeddings, "vec_id", "embedding", 0.4), "similarity")


VEDGES = "e AS (SELECT vec_id AS src, vec_id // 2 AS dst FROM embeddings WHERE vec_id > 0)"


def _vec_edges(t):
    return t.embeddings.where("vec_id > 0").select(F.col("vec_id").alias("src"), F.floor(F.col("vec_id") / 2).alias("dst"))


@query(
    "k55_similarity_on_edges",
    f"""WITH {VEC}, {VEDGES}, s AS (SELECT src, dst, {SIM} AS s FROM e JOIN c x ON x.vec_id = src JOIN c y ON y.vec_id = dst), st AS (SELECT median(s) AS m, stddev_pop(s) AS sd FROM s)
SELECT src, dst, {s6('s')} AS similarity, {s6('(s - m) / sd')} AS similarity_norm FROM s, st""",
)
def similarity_on_edges(t):
    s = stats.similarity_on_edges(t.embeddings, _vec_edges(t), "vec_id", "embedding")
    return _round(stats.robust_zscore(s, "similarity", "similarity_norm"), "similarity", "similarity_norm")


@query("k55_similarity_summary", f"WITH {VEC}, {VEDGES}, s AS (SELECT {SIM} AS s FROM e JOIN c x ON x.vec_id = src JOIN c y ON y.vec_id = dst) SELECT count(*) AS n_pairs, count(*) FILTER (WHERE s > 0.1) AS n_high, count(*) FILTER (WHERE s < -0.1) AS n_low, {s6('avg(s)')} AS mean FROM s")
def similarity_summary(t):
    s = stats.similarity_on_edges(t.embeddings, _vec_edges(t), "vec_id", "embedding")
    return _round(stats.similarity_summary(s, 0.1, -0.1), "mean")


@query("k55_top_pairs", f"WITH {VEC}, {VEDGES} SELECT src, dst, {s6(SIM)} AS similarity FROM e JOIN c x ON x.vec_id = src JOIN c y ON y.vec_id = dst ORDER BY {SIM} DESC, src LIMIT 10")
def top_pairs(t):
    s = stats.similarity_on_edges(t.embeddings, _vec_edges(t), "vec_id", "embedding")
    return _round(s.orderBy(F.desc("similarity"), "src").limit(10), "similarity")


@query(
    "k49_summary_rows",
    f"""WITH {SLOTS}, lm AS (SELECT series_id, ts, value, coalesce(value > 60, false) AS above, row_number() OVER (PARTITION BY series_id ORDER BY ts) - row_number() OVER (PARTITION BY series_id, coalesce(value > 60, false) ORDER BY ts) AS island, max(ts) OVER (PARTITION BY series_id) AS last_ts FROM grid),
ev AS (SELECT series_id, min(ts) AS start, count(*) * 0.25::DOUBLE AS h, max(value) AS peak FROM lm WHERE above GROUP BY series_id, island HAVING max(ts) + INTERVAL 15 MINUTE <= any_value(last_ts)),
lo AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY h DESC, start) AS r FROM ev), g AS (SELECT series_id, avg(CASE WHEN value IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) * 100 AS c, min(value) AS lo, max(value) AS hi, sum(value) AS tot FROM grid GROUP BY 1),
e AS (SELECT series_id, count(*) AS n, sum(h) AS h, max(peak) AS p FROM ev GROUP BY 1), lg AS (SELECT max(CAST(s_suppkey % 40 AS INTEGER)) AS m FROM supplier),
u AS (SELECT 'completeness_pct' AS section, series_id AS item, c AS value FROM g UNION ALL SELECT 'min', series_id, lo FROM g UNION ALL SELECT 'max', series_id, hi FROM g UNION ALL SELECT 'total', series_id, tot FROM g
UNION ALL SELECT 'n_events', series_id, n FROM e UNION ALL SELECT 'event_hours', series_id, h FROM e UNION ALL SELECT 'max_peak', series_id, p FROM e UNION ALL SELECT 'longest_event_h', series_id || '#' || r, h FROM lo WHERE r <= 5
UNION ALL SELECT 'max_lag_h', 'all', m FROM lg UNION ALL SELECT 'suggested_input_h', 'all', greatest(24, m + 6) FROM lg
UNION ALL SELECT 'event_share_pct', 'all', (SELECT sum(h) FROM ev) / ((SELECT count(DISTINCT ts) FROM grid) / 4) * 100)
SELECT section, item, {s6('value')} AS value FROM u""",
)
def summary_rows(t):
    g = grid(t)
    ev = windows.threshold_events(g, F.lit(60.0))
    lags = t.supplier.select(F.pmod("s_suppkey", F.lit(40)).cast("int").alias("peak_lag"))
    return _round(stats.summary_rows(g, ev, lags), "value")


@query(
    "k63_bankfull_anomaly",
    f"""WITH {NODES}, d AS (SELECT l_suppkey AS node, avg(l_quantity) / 10 AS mean_stage FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT node, {s6('p90')} AS bankfull, datum, {s6('mean_stage')} AS mean_stage, {s6('p90 - datum - mean_stage')} AS bankfull_anomaly FROM nodes JOIN d USING (node) WHERE datum > 0""",
)
def bankfull_anomaly(t):
    n = nodes(t)
    means = stats.train_mean(t.lineitem.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("node"), (F.col("l_quantity") / 10).alias("h")), "node", "h")
    out = stats.bankfull_anomaly(n.select("node", F.col("p90").alias("bankfull")), n.select("node", F.when(F.col("datum") > 0, F.col("datum")).alias("datum")), means)
    return _round(out, "bankfull", "mean_stage", "bankfull_anomaly")


@query("k65_reference_discharge", f"WITH {READINGS} SELECT {s6('greatest(avg(value) FILTER (WHERE quality_code < 70), 0.01)')} AS q_ref FROM readings")
def reference_discharge(t):
    return _round(stats.reference_discharge(readings(t).where("quality_code < 70"), "value"), "q_ref")
