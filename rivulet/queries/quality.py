"""Quality control over the readings and the forecast table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import quality, timegrid

from .base import FORECAST, READINGS, SLOTS, forecast, grid, query, r6, readings, s6

RANGE_CASE = "CASE WHEN value BETWEEN 0 AND CASE kind WHEN 'level' THEN 125 WHEN 'discharge' THEN 175 ELSE 100 END THEN value END"


@query("c1_range_filter", f"WITH {READINGS} SELECT seq, series_id, kind, {RANGE_CASE} AS value FROM readings")
def range_filter(t):
    return quality.range_filter(readings(t)).select("seq", "series_id", "kind", "value")


@query("c2_mask_bad_codes", f"WITH {READINGS} SELECT seq, series_id, CASE WHEN quality_code IN (1, 32, 101) THEN NULL ELSE value END AS value, quality_code = 99 AS quality_ok FROM readings")
def mask_bad_codes(t):
    return quality.mask_bad_codes(readings(t), bad=(1, 32, 101), good=99).select("seq", "series_id", "value", "quality_ok")


@query("c3_drop_negative", f"WITH {READINGS} SELECT seq, series_id, CASE WHEN value - 20 >= 0 THEN {s6('value - 20')} END AS value FROM readings")
def drop_negative(t):
    return quality.drop_negative(readings(t).withColumn("value", F.col("value") - 20)).select("seq", "series_id", r6("value").alias("value"))


@query(
    "c4_first_per_timestamp",
    f"WITH {READINGS}, h AS (SELECT user_id, date_trunc('hour', ts) AS hour, seq, value, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY seq) AS rn FROM readings) SELECT user_id, hour, seq, value FROM h WHERE rn = 1",
)
def first_per_timestamp(t):
    r = readings(t).select("user_id", timegrid.slot("ts", "1 hour").alias("hour"), "seq", "value")
    return quality.first_per_timestamp(r, "seq", keys=("user_id",), ts="hour")


GAPS = f"""{SLOTS},
flagged AS (SELECT series_id, ts, value IS NULL AS miss, row_number() OVER (PARTITION BY series_id ORDER BY ts) - row_number() OVER (PARTITION BY series_id, value IS NULL ORDER BY ts) AS island, max(ts) OVER (PARTITION BY series_id) AS last_ts FROM grid),
gaps AS (SELECT series_id, min(ts) AS start, least(max(ts) + INTERVAL 15 MINUTE, any_value(last_ts)) AS "end" FROM flagged WHERE miss GROUP BY series_id, island),
long_gaps AS (SELECT *, epoch_us("end" - start) / 3600000000.0::DOUBLE AS duration_hours FROM gaps WHERE epoch_us("end" - start) >= LIMIT_US)"""


@query("c6_gaps", f"WITH {GAPS.replace('LIMIT_US', '7200000000')} SELECT * FROM long_gaps")
def gaps(t):
    return quality.find_gaps(grid(t), min_hours=2.0)


@query(
    "c7_quality_report",
    f"""WITH {GAPS.replace('LIMIT_US', '3600000000')},
agg AS (SELECT series_id, count(*) AS total_steps, count(value) AS valid_steps, min(value) AS lo, max(value) AS hi FROM grid GROUP BY 1),
gg AS (SELECT series_id, count(*) AS n_gaps, max(duration_hours) AS longest FROM long_gaps GROUP BY 1)
SELECT a.series_id, total_steps, valid_steps, {s6('valid_steps / total_steps * 100')} AS completeness_pct, valid_steps / total_steps >= 0.5 AS passes,
  coalesce(n_gaps, 0) AS n_gaps, coalesce(longest, 0) AS longest_gap_h, {s6('lo')} AS min_value, {s6('hi')} AS max_value
FROM agg a LEFT JOIN gg USING (series_id)""",
)
def quality_report(t):
    g = grid(t)
    out = quality.quality_report(g, quality.find_gaps(g, min_hours=1.0), min_completeness=0.5)
    return out.withColumns({c: r6(c) for c in ("completeness_pct", "min_value", "max_value")})


@query(
    "c8_coverage_diagnosis",
    f"""WITH {READINGS}, c AS (SELECT series_id, quality_code, ts, {RANGE_CASE} AS value FROM readings)
SELECT series_id, quality_code, count(*) AS n, count(*) - count(value) AS n_unparsed, min(min(ts) FILTER (WHERE value IS NOT NULL)) OVER w AS first_valid,
  max(max(ts) FILTER (WHERE value IS NOT NULL)) OVER w AS last_valid, CAST(sum(count(*)) OVER w AS BIGINT) AS n_total,
  count(*) FILTER (WHERE ts IS NULL) AS n_bad_ts, (SELECT max(g) FROM (SELECT series_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY series_id ORDER BY ts), ts) / 900000000.0::DOUBLE AS g FROM c WHERE value IS NOT NULL) x WHERE x.series_id = c.series_id) AS largest_gap_steps,
  {s6('sum(count(value)) OVER w / sum(count(*)) OVER w')} AS coverage
FROM c GROUP BY series_id, quality_code WINDOW w AS (PARTITION BY series_id)""",
)
def coverage_diagnosis(t):
    return quality.coverage_diagnosis(quality.range_filter(readings(t))).withColumn("coverage", r6("coverage"))


def _features(t):
    return readings(t).select(
        "series_id", F.col("value").alias("stage"), (F.col("value") * 0).alias("discharge_m3s"),
        F.when(F.col("quality_code") > 30, F.col("value")).alias("rain"), F.lit(1.5).alias("flat"))


AUDIT_LONG = f"""{READINGS},
wide AS (SELECT series_id, value AS stage, value * 0 AS discharge_m3s, CASE WHEN quality_code > 30 THEN value END AS rain, 1.5::DOUBLE AS flat FROM readings),
long AS (SELECT series_id, unnest(['stage', 'discharge_m3s', 'rain', 'flat']) AS feature, unnest([stage, discharge_m3s, rain, flat]) AS value FROM wide),
st AS (SELECT GROUPKEYS feature, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std,
  count(*) FILTER (WHERE value = 0) / count(value) * 100 AS pct_zero, (count(*) - count(value)) / count(*) * 100 AS pct_null, count(*) AS n FROM long GROUP BY ALL)"""
AUDIT_OUT = f"""feature, min, max, {s6('mean')} AS mean, {s6('std')} AS std, {s6('pct_zero')} AS pct_zero, {s6('pct_null')} AS pct_null, n,
  concat_ws('; ', CASE WHEN min IS NULL THEN 'all null' END, CASE WHEN std < 1e-6 THEN 'constant' END, CASE WHEN pct_zero > 95 AND feature <> 'discharge_m3s' THEN 'mostly zero' END, CASE WHEN pct_null > 5 THEN 'many nulls' END) AS flags FROM st"""


@query("c9_feature_audit", f"WITH {AUDIT_LONG.replace('GROUPKEYS', '')} SELECT {AUDIT_OUT}")
def feature_audit(t):
    out = quality.feature_audit(_features(t), ("stage", "discharge_m3s", "rain", "flat"))
    return out.withColumns({c: r6(c) for c in ("mean", "std", "pct_zero", "pct_null")})


@query("c17_scenario_profile", f"WITH {AUDIT_LONG.replace('GROUPKEYS', 'series_id,')} SELECT series_id, {AUDIT_OUT}")
def scenario_profile(t):
    out = quality.feature_audit(_features(t), ("stage", "discharge_m3s", "rain", "flat"), by=("series_id",))
    return out.withColumns({c: r6(c) for c in ("mean", "std", "pct_zero", "pct_null")})


@query(
    "c10_array_summary",
    f"""WITH v AS (SELECT CASE WHEN value < 5 THEN 'NaN'::DOUBLE WHEN value > 300 THEN 'Infinity'::DOUBLE WHEN value < 10 THEN NULL ELSE value END AS x FROM events)
SELECT count(*) AS n, count(*) - count(x) AS n_null, count(*) FILTER (WHERE isnan(x)) AS n_nan, count(*) FILTER (WHERE isinf(x)) AS n_inf,
  min(x) FILTER (WHERE isfinite(x)) AS min, max(x) FILTER (WHERE isfinite(x)) AS max, {s6('avg(x) FILTER (WHERE isfinite(x))')} AS mean, {s6('stddev_pop(x) FILTER (WHERE isfinite(x))')} AS std FROM v""",
)
def array_summary(t):
    v = F.col("value")
    x = F.when(v < 5, float("nan")).when(v > 300, float("inf")).when(v < 10, None).otherwise(v)
    return quality.array_summary(t.events.select(x.alias("x")), "x").withColumns({"mean": r6("mean"), "std": r6("std")})


@query("c11_node_coverage", f"WITH {FORECAST} SELECT node, {s6('avg(CASE WHEN valid THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS coverage, avg(CASE WHEN valid THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) < 0.9 AS low FROM forecast GROUP BY node")
def node_coverage(t):
    return quality.node_coverage(forecast(t), F.col("valid"), "node", 0.9).withColumn("coverage", r6("coverage"))


@query(
    "c12_cross_check_keys",
    """SELECT count(f) AS n_fact_keys, count(d) AS n_dim_keys, count(*) - count(d) AS missing_in_dim, count(*) - count(f) AS missing_in_fact
FROM (SELECT DISTINCT user_id AS f FROM events) FULL JOIN (SELECT DISTINCT s_suppkey AS d FROM supplier) ON f = d""",
)
def cross_check_keys(t):
    return quality.cross_check_keys(t.events, t.supplier, "user_id", "s_suppkey")


@query(
    "c13_declared_flag_mismatch",
    f"""WITH z AS (SELECT o_custkey AS node, count(*) FILTER (WHERE o_totalprice < 250000) / count(*) AS zero_share FROM orders GROUP BY 1)
SELECT z.node, c_acctbal > 0 AS has_discharge, {s6('zero_share')} AS zero_share, zero_share < 0.6 AS observed FROM z JOIN customer ON c_custkey = z.node WHERE (c_acctbal > 0) <> (zero_share < 0.6)""",
)
def declared_flag_mismatch(t):
    facts = t.orders.select(F.col("o_custkey").alias("node"), F.when(F.col("o_totalprice") < 250000, 0.0).otherwise(F.col("o_totalprice")).alias("q"))
    dims = t.customer.select(F.col("c_custkey").alias("node"), (F.col("c_acctbal") > 0).alias("has_discharge"))
    return quality.declared_flag_mismatch(facts, dims, "node", "q", "has_discharge", 0.6).withColumn("zero_share", r6("zero_share"))


@query("c14_duplicate_keys", "SELECT user_id, date_trunc('day', ts) AS day, event_type, count(*) AS n_rows FROM events GROUP BY ALL HAVING count(*) > 1 AND event_type <> 'view'")
def duplicate_keys(t):
    e = t.events.select("user_id", timegrid.slot("ts", "1 day").alias("day"), "event_type")
    return quality.duplicate_keys(e, ("user_id", "day", "event_type"), F.col("event_type") != "view")


CELLS = f"""{READINGS},
cells AS (SELECT series_id AS cell_id, time_bucket(INTERVAL 1 HOUR, ts) AS ts, CASE WHEN avg(value) < 200 THEN avg(value) / 160 END AS swvl1, avg(value) / 400 AS swvl2 FROM readings GROUP BY 1, 2)"""


def cells(t):
    """Hourly soil moisture stand-in: one cell per series."""
    g = timegrid.resample(readings(t), "1 hour")
    return g.select(F.col("series_id").alias("cell_id"), "ts", F.when(F.col("value") < 200, F.col("value") / 160).alias("swvl1"), (F.col("value") / 400).alias("swvl2"))


def _layer_rules(layer):
    return f"""SELECT '{layer}_null_share' AS rule, avg(CASE WHEN {layer} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS value, avg(CASE WHEN {layer} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) <= 0.05 AS ok FROM cells
UNION ALL SELECT '{layer}_out_of_range', CAST(count(*) FILTER (WHERE {layer} < -0.01 OR {layer} > 0.65) AS DOUBLE), count(*) FILTER (WHERE {layer} < -0.01 OR {layer} > 0.65) = 0 FROM cells
UNION ALL SELECT '{layer}_mean', avg({layer}), avg({layer}) BETWEEN 0.20 AND 0.47 FROM cells"""


@query(
    "c15_validate_gridded",
    f"""WITH {CELLS}, r AS ({_layer_rules('swvl1')} UNION ALL {_layer_rules('swvl2')}
UNION ALL SELECT 'repeated_steps', 0.0::DOUBLE, true UNION ALL SELECT 'node_count', CAST(count(DISTINCT cell_id) AS DOUBLE), count(DISTINCT cell_id) = 5 FROM cells)
SELECT rule, {s6('value')} AS value, CASE WHEN ok THEN 'ok' ELSE 'fail' END AS status FROM r""",
)
def validate_gridded(t):
    return quality.validate_gridded(cells(t), ("swvl1", "swvl2"), 5).withColumn("value", r6("value"))


@query("c16_mean_plausibility", f"WITH {CELLS} SELECT cell_id, {s6('avg(swvl2)')} AS mean, CASE WHEN avg(swvl2) IS NULL OR abs(avg(swvl2)) < 1e-3 THEN 'empty' WHEN avg(swvl2) BETWEEN 0.125 AND 0.47 THEN 'plausible' ELSE 'implausible' END AS verdict FROM cells GROUP BY 1")
def mean_plausibility(t):
    return quality.mean_plausibility(cells(t), "swvl2", ("cell_id",), lo=0.125).withColumn("mean", r6("mean"))


@query(
    "c18_parameter_audit",
    f"""WITH {FORECAST}, p AS (SELECT model, horizon, count(*) AS n, count(*) FILTER (WHERE NOT pred BETWEEN 0 AND 1) AS n_out FROM forecast GROUP BY 1, 2)
SELECT model, horizon, n, n_out, {s6('n_out / n')} AS share_out, CASE WHEN n_out = n THEN 'systemic' WHEN n_out > 0 THEN 'partial' ELSE 'none' END AS verdict FROM p""",
)
def parameter_audit(t):
    return quality.parameter_audit(forecast(t), "pred", ("model", "horizon")).withColumn("share_out", r6("share_out"))


@query(
    "c19_gate_lead",
    f"""WITH {FORECAST}, g AS (SELECT model, node, min(epoch_us(ts)) FILTER (WHERE 1 / (1 + exp(-(pred - 1.5))) >= 0.5) AS gate_step, min(epoch_us(ts)) FILTER (WHERE target > 1.8) AS cross_step FROM forecast GROUP BY 1, 2)
SELECT *, cross_step - gate_step AS lead_steps, CASE WHEN gate_step IS NULL THEN 'never opens' WHEN cross_step IS NULL THEN 'never crosses' WHEN cross_step - gate_step >= 0 THEN 'leads' ELSE 'lags' END AS outcome FROM g""",
)
def gate_lead(t):
    from rivulet.functions.expr import sigmoid
    from rivulet.plans.timechunks import micros

    f = forecast(t).withColumn("at", micros("ts"))
    return quality.gate_lead(f, ("model", "node"), "at", sigmoid(F.col("pred") - 1.5), F.col("target") > 1.8)


@query(
    "c20_physical_guards",
    f"""WITH {READINGS}, f AS (SELECT seq, value - 50 AS stage, value - 60 AS rain, value / 100 AS sat, value / 10 - 4 AS pos FROM readings),
lim AS (SELECT quantile_cont(abs(stage), 0.99) * 1.5::DOUBLE AS l FROM f)
SELECT seq, {s6('least(greatest(stage, -l), l)')} AS stage, {s6('greatest(rain, 0)')} AS rain, {s6('least(greatest(sat, 0), 1)')} AS sat, {s6('least(greatest(pos, -2), 5)')} AS pos FROM f, lim""",
)
def physical_guards(t):
    v = F.col("value")
    f = readings(t).select("seq", (v - 50).alias("stage"), (v - 60).alias("rain"), (v / 100).alias("sat"), (v / 10 - 4).alias("pos"))
    out = quality.physical_guards(f, ("stage",), rain="rain", saturation="sat", norm="pos", factor=1.5)
    return out.withColumns({c: r6(c) for c in ("stage", "rain", "sat", "pos")})


@query(
    "c21_mask_outages",
    """WITH o AS (SELECT o_custkey AS node, o_orderdate AS start, o_orderdate + INTERVAL 30 DAY AS "end" FROM orders),
f AS (SELECT l_orderkey, l_linenumber, o_custkey AS node, l_shipdate AS ts, l_quantity AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT f.l_orderkey, f.l_linenumber, f.node, f.ts, EXISTS (SELECT 1 FROM o WHERE o.node = f.node AND f.ts >= o.start AND f.ts < o."end") AS masked,
  CASE WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.node = f.node AND f.ts >= o.start AND f.ts < o."end") THEN value END AS value FROM f""",
)
def mask_outages(t):
    orders = t.orders
    o = orders.select(F.col("o_custkey").alias("node"), F.col("o_orderdate").alias("start"), F.expr("o_orderdate + interval 30 days").alias("end"))
    f = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("value")).join(
        orders.select("o_orderkey", F.col("o_custkey").alias("node")), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return quality.mask_outages(f, o, ("value",))


@query(
    "c22_drop_profile_outliers",
    """WITH p AS (SELECT *, median(l_extendedprice) OVER w AS m, stddev_pop(l_extendedprice) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_suppkey))
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM p WHERE abs(l_extendedprice - m) < 1.5 * s""",
)
def drop_profile_outliers(t):
    li = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return quality.drop_profile_outliers(li, ("l_suppkey",), "l_extendedprice", 1.5)


@query(
    "a4_download_summary",
    f"""WITH {READINGS}, c AS (SELECT series_id, kind, ts, {RANGE_CASE} AS value FROM readings)
SELECT series_id, kind, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, {s6('avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100')} AS missing_pct,
  {s6("CASE WHEN kind = 'rainfall' THEN sum(value) ELSE avg(value) END")} AS mean_or_total FROM c GROUP BY 1, 2""",
)
def download_summary(t):
    return quality.download_summary(quality.range_filter(readings(t))).withColumns({"missing_pct": r6("missing_pct"), "mean_or_total": r6("mean_or_total")})


@query(
    "c24_score_gap",
    f"""WITH {FORECAST}, a AS (SELECT model, seed, horizon, 1 - sum((target - pred)^2) / (var_pop(target) * count(*)) AS nse FROM forecast WHERE valid GROUP BY 1, 2, 3),
b AS (SELECT model, seed, horizon, 1 - sum((target - pred)^2) / (var_pop(target) * count(*)) AS nse FROM forecast GROUP BY 1, 2, 3)
SELECT model, seed, horizon, {s6('a.nse')} AS recomputed, {s6('b.nse')} AS stored, {s6('abs(a.nse - b.nse)')} AS gap, CASE WHEN abs(a.nse - b.nse) < 0.01 THEN 'ok' ELSE 'check' END AS verdict FROM a JOIN b USING (model, seed, horizon)""",
)
def score_gap(t):
    from rivulet.operators import scores

    f = forecast(t)
    keys = ("model", "seed", "horizon")
    a = scores.pooled_scores(f.where("valid"), keys)
    b = scores.pooled_scores(f, keys)
    return quality.score_gap(a, b, keys, tolerance=0.01).withColumns({c: r6(c) for c in ("recomputed", "stored", "gap")})
