"""Grids, resampling, features, windows and splits over the readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import quality, timegrid, windows
from rivulet.plans.timechunks import HOUR
from rivulet.sources import sinks

from .base import HOURLY, READINGS, SLOTS, grid, query, r6, readings, s6

CLEAN = f"""{READINGS},
clean AS (SELECT series_id, ts, CASE WHEN value BETWEEN 0 AND CASE kind WHEN 'level' THEN 125 WHEN 'discharge' THEN 175 ELSE 100 END THEN value END AS value FROM readings),
slots AS (SELECT series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS value FROM clean GROUP BY 1, 2),
axis AS (SELECT unnest(generate_series((SELECT min(ts) FROM slots), (SELECT max(ts) FROM slots), INTERVAL 15 MINUTE)) AS ts),
grid AS (SELECT s.series_id, a.ts, v.value FROM (SELECT DISTINCT series_id FROM clean) s CROSS JOIN axis a LEFT JOIN slots v ON v.series_id = s.series_id AND v.ts = a.ts)"""
WEEK = "RANGE BETWEEN (INTERVAL 7 DAY - INTERVAL 1 MICROSECOND) PRECEDING AND CURRENT ROW"


FEATURES = f"""WITH {CLEAN},
params AS (SELECT series_id, min(value) AS datum, max(value) * 0.4::DOUBLE AS p90 FROM clean GROUP BY 1),
f AS (
  SELECT g.series_id, g.ts, g.value, p.datum, p.p90,
    g.value - avg(g.value) OVER (PARTITION BY g.series_id ORDER BY g.ts {WEEK}) AS anom,
    lag(g.value) OVER w AS prev
  FROM grid g JOIN params p USING (series_id) WINDOW w AS (PARTITION BY g.series_id ORDER BY g.ts))
SELECT series_id, ts, {s6('anom')} AS stage_anomaly,
  {s6('CASE WHEN value IS NOT NULL THEN least(greatest((value - datum) / CASE WHEN p90 - datum > 0.01 THEN p90 - datum ELSE 1 END, -2), 5) END')} AS normalized_stage,
  {s6('coalesce((value - prev) * 4, 0)')} AS dh_dt,
  {s6('sign(coalesce(value, 0)) * ln(1 + abs(coalesce(value, 0)))')} AS discharge_m3s,
  {s6('greatest(coalesce(value, 0), 0)')} AS rainfall_mm,
  {s6('lead(anom) OVER (PARTITION BY series_id ORDER BY ts)')} AS target, value IS NOT NULL AS valid
FROM f"""


@query("e3_e4_gauge_features", FEATURES)
def gauge_features(t):
    clean = quality.range_filter(readings(t))
    params = clean.groupBy("series_id").agg(F.min("value").alias("datum"), (F.max("value") * 0.4).alias("p90"))
    g = timegrid.regular_grid(clean).join(params, "series_id")
    level = g.withColumnsRenamed({"value": "level"}).withColumn("discharge", F.col("level")).withColumn("rain", F.col("level"))
    out = windows.gauge_features(level)
    return out.withColumns({c: r6(c) for c in ("stage_anomaly", "normalized_stage", "dh_dt", "discharge_m3s", "rainfall_mm", "target")})


@query("d1_resample_mean", f"WITH {SLOTS} SELECT series_id, ts, {s6('value')} AS value FROM slots")
def resample_mean(t):
    return timegrid.resample(readings(t)).withColumn("value", r6("value"))


@query("d1_resample_hourly", f"WITH {HOURLY} SELECT series_id, ts, {s6('value')} AS value FROM slots")
def resample_hourly(t):
    return timegrid.resample(readings(t), "1 hour").withColumn("value", r6("value"))


@query(
    "d2_resample_sum_own_span",
    f"""WITH {READINGS},
s AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS ts, sum(value) AS value FROM readings GROUP BY 1, 2),
a AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM s GROUP BY user_id)
SELECT a.user_id, a.ts, {s6('coalesce(s.value, 0)')} AS value FROM a LEFT JOIN s USING (user_id, ts)""",
)
def resample_sum_own_span(t):
    return timegrid.resample_own_span(readings(t), "1 hour", keys=("user_id",)).withColumn("value", r6("value"))


@query("d3_resample_sum_null", f"WITH {HOURLY} SELECT series_id, ts, {s6('total')} AS value FROM hourly")
def resample_sum_null(t):
    return timegrid.regular_grid(readings(t), "1 hour", "sum").withColumn("value", r6("value"))


@query("d4_complete_grid", f"WITH {SLOTS} SELECT series_id, ts, {s6('value')} AS value FROM grid")
def complete_grid(t):
    return grid(t).withColumn("value", r6("value"))


@query(
    "d5_align_nearest_hourly",
    f"""WITH {SLOTS},
src AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) AS value FROM readings WHERE series_id = 'click' GROUP BY 1),
tgt AS (SELECT series_id, ts FROM grid WHERE series_id <> 'click'),
m AS (SELECT g.series_id, g.ts, arg_min(s.value, {{'d': abs(epoch_us(s.ts) - epoch_us(g.ts)), 'l': -epoch_us(s.ts)}}) AS value
  FROM tgt g LEFT JOIN src s ON s.ts BETWEEN g.ts - INTERVAL 1 HOUR AND g.ts + INTERVAL 1 HOUR GROUP BY 1, 2)
SELECT series_id, ts, {s6('value')} AS value FROM m""",
)
def align_nearest_hourly(t):
    """Every other series' quarter hours take the click series' hourly value nearest in time."""
    src = timegrid.resample(readings(t).where("series_id = 'click'"), "1 hour").select("ts", "value")
    targets = grid(t).where("series_id <> 'click'").select("series_id", "ts")
    at = targets.select("ts").distinct()
    found = timegrid.align_nearest(at, src, HOUR)
    return targets.join(found, "ts", "left").select("series_id", "ts", r6("value").alias("value"))


@query(
    "d6_nearest_step",
    """WITH ev AS (SELECT event_id, ts FROM events),
st AS (SELECT DISTINCT time_bucket(INTERVAL 1 DAY, ts) AS step_ts FROM events),
m AS (SELECT e.event_id, e.ts, arg_min(s.step_ts, {'d': abs(epoch_us(s.step_ts) - epoch_us(e.ts)), 'o': epoch_us(s.step_ts)}) AS step_ts
  FROM ev e CROSS JOIN st s GROUP BY 1, 2)
SELECT event_id, ts, step_ts, round(abs(epoch_us(step_ts) - epoch_us(ts)) / 3600000000.0::DOUBLE, 6) AS lag_hours,
  abs(epoch_us(step_ts) - epoch_us(ts)) / 3600000000.0::DOUBLE > 6 AS warn FROM m""",
)
def nearest_step(t):
    ev = t.events.select("event_id", "ts")
    steps = t.events.select(timegrid.slot("ts", "1 day").alias("step_ts"))
    return timegrid.nearest_step(ev, steps).withColumn("lag_hours", F.round("lag_hours", 6))


@query("d7_clip_period", f"WITH {READINGS} SELECT series_id, ts, value, seq FROM readings WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def clip_period(t):
    return timegrid.clip_period(readings(t).select("series_id", "ts", "value", "seq"), "2024-01-05 00:00:00", "2024-01-20 00:00:00")


@query("d10_monthly_completeness", f"WITH {SLOTS} SELECT series_id, strftime(ts, '%Y-%m') AS month, {s6('avg(CASE WHEN value IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100')} AS completeness_pct FROM grid GROUP BY 1, 2")
def monthly_completeness(t):
    return timegrid.monthly_completeness(grid(t)).withColumn("completeness_pct", r6("completeness_pct"))


@query(
    "d11_sample_windows",
    f"""WITH {SLOTS},
w AS (SELECT series_id, ts, list(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS xi,
  list(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS yi FROM grid)
SELECT series_id, ts, CAST(len(list_filter(xi, lambda v: v IS NOT NULL)) AS INTEGER) AS n_inputs, CAST(len(list_filter(yi, lambda v: v IS NOT NULL)) AS INTEGER) AS n_targets,
  {s6('xi[1]')} AS first_input, {s6('xi[32]')} AS last_input, {s6('yi[1]')} AS first_target, {s6('yi[12]')} AS last_target
FROM w WHERE len(xi) = 32 AND len(yi) = 12""",
)
def sample_windows(t):
    w = timegrid.sample_windows(grid(t), 32, 12)
    known = lambda c: F.size(F.filter(c, lambda v: v.isNotNull()))
    return w.select(
        "series_id", "ts", known("inputs").alias("n_inputs"), known("targets").alias("n_targets"),
        r6(F.get("inputs", F.lit(0))).alias("first_input"), r6(F.get("inputs", F.lit(31))).alias("last_input"),
        r6(F.get("targets", F.lit(0))).alias("first_target"), r6(F.get("targets", F.lit(11))).alias("last_target"))


INDEXED = f"""WITH {SLOTS},
i AS (SELECT series_id, ts, value, CAST((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM grid)) // 900000000 AS BIGINT) AS idx, (SELECT count(DISTINCT ts) FROM grid) AS n FROM grid)"""


@query(
    "d12_split_by_windows",
    f"""{INDEXED},
p AS (SELECT *, floor((n - 43) * 0.7::DOUBLE) AS a, floor((n - 43) * 0.15::DOUBLE) AS v FROM i),
s AS (SELECT series_id, ts, idx, CASE WHEN idx < a THEN 'train' WHEN idx >= a + 44 AND idx < a + 44 + v THEN 'val'
  WHEN idx >= a + v + 88 AND idx < n - 43 THEN 'test' END AS split FROM p)
SELECT * FROM s WHERE split IS NOT NULL""",
)
def split_by_windows(t):
    return timegrid.split_by_windows(grid(t), 32, 12, source=t.events).select("series_id", "ts", "idx", "split")


@query(
    "d13_split_by_time",
    f"""{INDEXED},
p AS (SELECT *, floor(n * 0.7::DOUBLE) AS a, floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS b FROM i),
s AS (SELECT series_id, ts, idx, CASE WHEN idx <= a - 44 THEN 'train' WHEN idx >= a + 43 AND idx <= b - 44 THEN 'val' WHEN idx >= b + 43 AND idx <= n - 44 THEN 'test' END AS split FROM p)
SELECT * FROM s WHERE split IS NOT NULL""",
)
def split_by_time(t):
    return timegrid.split_by_time(grid(t), 32, 12, source=t.events).select("series_id", "ts", "idx", "split")


@query("d14_train_slice", f"{INDEXED} SELECT series_id, ts, {s6('value')} AS value, idx FROM i WHERE idx < floor(n * 0.7::DOUBLE)")
def train_slice(t):
    return timegrid.train_slice(grid(t), source=t.events).select("series_id", "ts", r6("value").alias("value"), "idx")


@query(
    "d15_window_position",
    f"{INDEXED} SELECT series_id, ts, (idx + 43) // 104 AS window_id, (idx + 43) % 104 AS local_step FROM i",
)
def window_position(t):
    g = grid(t)
    cols = timegrid.window_position(timegrid.step_index(t.events), 104, 32, 12)
    return g.select("series_id", "ts", *[c.alias(n) for n, c in cols.items()])


@query(
    "e1_stage_anomaly",
    f"WITH {SLOTS} SELECT series_id, ts, {s6(f'value - avg(value) OVER (PARTITION BY series_id ORDER BY ts {WEEK})')} AS stage_anomaly FROM grid",
)
def stage_anomaly(t):
    return windows.stage_anomaly(grid(t)).select("series_id", "ts", r6("stage_anomaly").alias("stage_anomaly"))


@query("e2_rate_of_change", f"WITH {SLOTS} SELECT series_id, ts, {s6('coalesce((value - lag(value) OVER (PARTITION BY series_id ORDER BY ts)) * 4, 0)')} AS dh_dt FROM grid")
def rate_of_change(t):
    return windows.rate_of_change(grid(t)).select("series_id", "ts", r6("dh_dt").alias("dh_dt"))


@query("e4_next_step_target", f"WITH {SLOTS} SELECT series_id, ts, {s6('lead(value, 4) OVER (PARTITION BY series_id ORDER BY ts)')} AS target FROM grid")
def next_step_target(t):
    return windows.next_step_target(grid(t), "value", 4).select("series_id", "ts", r6("target").alias("target"))


@query(
    "c5_forward_fill",
    f"WITH {SLOTS} SELECT series_id, ts, {s6('coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0)')} AS filled FROM grid",
)
def forward_fill(t):
    return windows.forward_fill(grid(t), "value").select("series_id", "ts", r6("filled").alias("filled"))


@query(
    "e5_rolling_rain_30d",
    f"WITH {HOURLY} SELECT series_id, ts, {s6('sum(total) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 719 PRECEDING AND CURRENT ROW)')} AS rolling FROM hourly",
)
def rolling_rain(t):
    g = timegrid.regular_grid(readings(t), "1 hour", "sum")
    return windows.rolling_sum(g, 720, HOUR).select("series_id", "ts", r6("rolling").alias("rolling"))


@query(
    "k43_flood_labels",
    f"""WITH {SLOTS}
SELECT series_id, ts, CAST(max(value) OVER w > 90 AS INTEGER) AS label, coalesce(bool_or(value IS NOT NULL) OVER w, false) AS node_valid
FROM grid WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)""",
)
def flood_labels(t):
    g = grid(t).withColumn("ok", F.col("value").isNotNull())
    return windows.horizon_label(g, 12, F.lit(90.0), valid="ok").select("series_id", "ts", "label", "node_valid")


DYNAMIC = ("stage_anomaly", "normalized_stage", "dh_dt", "discharge_m3s", "rainfall_mm")


@query("a12_long_export", f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, series_id AS node_ref, {', '.join(DYNAMIC)}, target AS target_y, CASE WHEN valid THEN 1 ELSE 0 END AS valid FROM ({FEATURES}) x")
def long_export(t):
    return sinks.long_format(gauge_features(t), DYNAMIC)
