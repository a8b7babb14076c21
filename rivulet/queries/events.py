"""Events, peaks, seasonal summaries, climatology and response rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import timegrid, windows
from rivulet.plans.fixpoint import cut
from rivulet.plans.timechunks import HOUR, STEP

from .base import HOURLY, READINGS, SLOTS, grid, query, r6, readings, s6


def _round(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


ISLANDS = f"""{SLOTS},
marked AS (SELECT series_id, ts, value, coalesce(value > 60, false) AS above, row_number() OVER (PARTITION BY series_id ORDER BY ts) - row_number() OVER (PARTITION BY series_id, coalesce(value > 60, false) ORDER BY ts) AS island, max(ts) OVER (PARTITION BY series_id) AS last_ts FROM grid),
ev AS (SELECT series_id, min(ts) AS start, max(ts) + INTERVAL 15 MINUTE AS "end", count(*) * 0.25::DOUBLE AS duration_h, max(value) AS peak, arg_max(ts, {{'v': value, 't': -epoch_us(ts)}}) AS peak_ts, any_value(last_ts) AS last_ts FROM marked WHERE above GROUP BY series_id, island)"""


@query("e7_threshold_events", f"""WITH {ISLANDS} SELECT series_id, start, "end", duration_h, {s6('peak')} AS peak, peak_ts, {s6('peak - 60')} AS excess FROM ev WHERE "end" <= last_ts""")
def threshold_events(t):
    return _round(windows.threshold_events(grid(t), F.lit(60.0)), "peak", "excess")


def _area(thr, hours):
    return f"""SELECT min(ts) AS start, max(ts) + INTERVAL 15 MINUTE AS "end", count(*) * 0.25::DOUBLE AS duration_h, max(value) AS peak, arg_max(ts, {{'v': value, 't': -epoch_us(ts)}}) AS peak_ts
FROM (SELECT ts, value, row_number() OVER (ORDER BY ts) - row_number() OVER (PARTITION BY coalesce(value > {thr}, false) ORDER BY ts) AS island, coalesce(value > {thr}, false) AS above FROM area) WHERE above GROUP BY island HAVING count(*) * 0.25::DOUBLE >= {hours}"""


AREA = f"{SLOTS}, area AS (SELECT ts, max(value) AS value FROM grid GROUP BY 1)"
FALLBACK = """SELECT greatest(t - INTERVAL 12 HOUR, lo) AS start, least(t + INTERVAL 12 HOUR, hi + INTERVAL 15 MINUTE) AS "end", v AS peak, t AS peak_ts
FROM (SELECT arg_max(ts, {'v': value, 't': -epoch_us(ts)}) FILTER (WHERE value IS NOT NULL) AS t, max(value) AS v, min(ts) AS lo, max(ts) AS hi FROM area)"""


@query("e8_area_events", f"""WITH {AREA}, ev AS ({_area(30, 2)}) SELECT start, "end", duration_h, {s6('peak')} AS peak, peak_ts, {s6('peak - 30')} AS excess FROM ev""")
def area_events(t):
    return _round(windows.area_events(grid(t), 30.0, 2.0), "peak", "excess")


@query(
    "e9_most_severe_event",
    f"""WITH {AREA}, ev AS ({_area(30, 2)}), allv AS (SELECT start, "end", peak, peak_ts, 0 AS rung FROM ev UNION ALL SELECT start, "end", peak, peak_ts, 1 FROM ({FALLBACK}))
SELECT start, "end", {s6('peak')} AS peak, peak_ts FROM allv ORDER BY rung, allv.peak DESC, start LIMIT 1""",
)
def most_severe_event(t):
    return _round(windows.most_severe_event(grid(t), 30.0, 2.0), "peak")


@query("e9_fallback_event", f"""WITH {AREA} SELECT start, "end", {s6('peak')} AS peak, peak_ts FROM ({FALLBACK})""")
def fallback_event(t):
    return _round(windows.most_severe_event(grid(t), 1e6, 6.0), "peak")


@query(
    "e22_event_ladder",
    f"""WITH {AREA}, a AS ({_area(400, 3)}), b AS ({_area(60, 1)}),
u AS (SELECT start, "end", peak, peak_ts, 0 AS rung FROM a UNION ALL SELECT start, "end", peak, peak_ts, 1 FROM b UNION ALL SELECT start, "end", peak, peak_ts, 2 FROM ({FALLBACK}))
SELECT start, "end", {s6('peak')} AS peak, peak_ts, rung FROM u WHERE rung = (SELECT min(rung) FROM u) ORDER BY u.peak DESC, start LIMIT 5""",
)
def event_ladder(t):
    """Top events of the first rung that finds any; the limit is the report's."""
    return _round(windows.event_ladder(grid(t), ((400.0, 3.0), (60.0, 1.0)), top=5), "peak")


@query(
    "e10_cluster_events",
    f"""WITH {READINGS}, r AS (SELECT user_id, ts, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 7200000000 THEN 0 ELSE 1 END AS fresh FROM readings WHERE value > 20),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS grp FROM r)
SELECT user_id, min(ts) AS run_start, max(ts) AS run_end, count(*) AS n_rows, {s6('sum(value)')} AS total, max(value) AS peak FROM g GROUP BY user_id, grp""",
)
def cluster_events(t):
    wet = readings(t).where("value > 20").select("user_id", "ts", "value")
    return _round(windows.cluster_events(wet, 8 * STEP, ("user_id",)), "total")


@query(
    "e12_local_maxima",
    f"""WITH {SLOTS}, f AS (SELECT series_id, ts, coalesce(value, '-infinity'::DOUBLE) AS value FROM grid),
r AS (SELECT series_id, ts, value, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM f),
c AS (SELECT *, i - row_number() OVER (PARTITION BY series_id, value ORDER BY i) AS island FROM r),
p AS (SELECT series_id, value, min(i) AS a, max(i) AS z FROM c GROUP BY series_id, value, island),
q AS (SELECT p.*, l.value AS lv, n.value AS nv FROM p JOIN r l ON l.series_id = p.series_id AND l.i = p.a - 1 JOIN r n ON n.series_id = p.series_id AND n.i = p.z + 1)
SELECT q.series_id, m.ts, {s6('q.value')} AS value FROM q JOIN r m ON m.series_id = q.series_id AND m.i = (q.a + q.z) // 2 WHERE q.value > lv AND q.value > nv AND q.value >= 60""",
)
def local_maxima(t):
    return _round(windows.local_maxima(grid(t), F.lit(60.0)), "value")


def peak_ctes(source: str, name: str, sep_us: int) -> str:
    """CTEs that find local maxima of `source`(k, ts, value, floor_value) and thin them greedily: `name`(k, us, value).

    Written for WITH RECURSIVE; the walk goes through the peaks of a key from the highest down.
    """
    return f"""{name}_r AS (SELECT k, ts, value, floor_value, row_number() OVER (PARTITION BY k ORDER BY ts) AS i FROM {source}),
{name}_c AS (SELECT *, i - row_number() OVER (PARTITION BY k, value ORDER BY i) AS island FROM {name}_r),
{name}_p AS (SELECT k, value, any_value(floor_value) AS fv, min(i) AS a, max(i) AS z FROM {name}_c GROUP BY k, value, island),
{name}_m AS (SELECT p.k, epoch_us(m.ts) AS us, p.value FROM {name}_p p JOIN {name}_r l ON l.k = p.k AND l.i = p.a - 1 JOIN {name}_r n ON n.k = p.k AND n.i = p.z + 1 JOIN {name}_r m ON m.k = p.k AND m.i = (p.a + p.z) // 2 WHERE p.value > l.value AND p.value > n.value AND p.value >= p.fv),
{name}_o AS (SELECT k, us, value, row_number() OVER (PARTITION BY k ORDER BY value DESC, us DESC) AS r FROM {name}_m),
{name}_w(k, r, kept) AS (SELECT DISTINCT k, 0::BIGINT, []::BIGINT[] FROM {name}_o UNION ALL
  SELECT w.k, o.r, CASE WHEN len(list_filter(w.kept, lambda x: abs(x - o.us) < {sep_us})) = 0 THEN list_append(w.kept, o.us) ELSE w.kept END FROM {name}_w w JOIN {name}_o o ON o.k = w.k AND o.r = w.r + 1),
{name}_k AS (SELECT k, unnest(kept) AS us FROM (SELECT k, arg_max(kept, r) AS kept FROM {name}_w GROUP BY 1)),
{name} AS (SELECT o.k, o.us, o.value FROM {name}_o o JOIN {name}_k USING (k, us))"""


FOUR_HOURS = 4 * 3_600_000_000


@query("e12_thinned_peaks", f"""WITH RECURSIVE {SLOTS}, src AS (SELECT series_id AS k, ts, coalesce(value, '-infinity'::DOUBLE) AS value, 60 AS floor_value FROM grid), {peak_ctes('src', 'tp', FOUR_HOURS)} SELECT k AS series_id, make_timestamp(us) AS ts, {s6('value')} AS value FROM tp""")
def thinned_peaks(t):
    return _round(windows.thin_peaks(windows.local_maxima(grid(t), F.lit(60.0)), 4 * HOUR), "value")


def shifted_forecast(t):
    """Observed grid and a prediction that repeats it three steps late and damped; both null where either is missing.

    The pair is written once: each of the passes over it would otherwise plan the grid, its bounds and the join again, on the driver.
    """
    g = grid(t).select("series_id", "ts", "value")
    late = g.select("series_id", F.expr("ts + interval 45 minutes").alias("ts"), (F.col("value") * 0.8).alias("pred"))
    both = cut(g.join(late, ["series_id", "ts"], "left"))
    valid = F.col("value").isNotNull() & F.col("pred").isNotNull()
    return both.select("series_id", "ts", F.when(valid, F.col("value")).alias("value")), both.select("series_id", "ts", F.when(valid, F.col("pred")).alias("value"))


def timing_ctes(window: bool) -> str:
    """Observed thinned peaks and, per observed one, the nearest peak of the prediction's window of two days, or its highest step: `tm`."""
    key = "series_id || '#' || ((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM grid)) // 900000000 // 104)" if window else "series_id"
    return f"""pr AS (SELECT g.series_id, g.ts, g.value AS o, h.value * 0.8::DOUBLE AS p FROM grid g LEFT JOIN grid h ON h.series_id = g.series_id AND h.ts = g.ts - INTERVAL 45 MINUTE),
obs0 AS (SELECT series_id, ts, CASE WHEN p IS NOT NULL THEN o END AS value FROM pr), pred0 AS (SELECT series_id, ts, CASE WHEN o IS NOT NULL THEN p END AS value FROM pr),
osrc AS (SELECT {key} AS k, ts, coalesce(value, '-infinity'::DOUBLE) AS value, 90 AS floor_value FROM obs0), psrc AS (SELECT {key} AS k, ts, coalesce(value, '-infinity'::DOUBLE) AS value FROM pred0),
{peak_ctes('osrc', 'op', FOUR_HOURS)},
pw AS (SELECT o.k || '@' || o.us AS k, o.us AS obs_us, p.ts, p.value, '-infinity'::DOUBLE AS floor_value FROM op o JOIN psrc p ON p.k = o.k AND epoch_us(p.ts) >= o.us - 172800000000 AND epoch_us(p.ts) < o.us + 172800000000),
{peak_ctes('pw', 'pp', FOUR_HOURS)},
top AS (SELECT k, arg_max(epoch_us(ts) - obs_us, {{'v': value, 'g': obs_us - epoch_us(ts)}}) AS g FROM pw WHERE value > '-infinity'::DOUBLE GROUP BY 1),
nearest AS (SELECT o.k, o.us, arg_min(p.us - o.us, {{'d': abs(p.us - o.us), 'g': p.us - o.us}}) AS g FROM op o JOIN pp p ON p.k = o.k || '@' || o.us GROUP BY 1, 2),
tm AS (SELECT o.k, o.us, o.value AS obs_peak, coalesce(n.g, top.g) / 3600000000.0::DOUBLE AS error_h FROM op o JOIN top ON top.k = o.k || '@' || o.us LEFT JOIN nearest n ON n.k = o.k AND n.us = o.us)"""


@query("e13_peak_timing_error", f"""WITH RECURSIVE {SLOTS}, {timing_ctes(False)} SELECT k AS series_id, make_timestamp(us) AS obs_ts, {s6('obs_peak')} AS obs_peak, error_h, abs(error_h) AS abs_error_h FROM tm""")
def peak_timing_error(t):
    obs, pred = shifted_forecast(t)
    op = windows.thin_peaks(windows.local_maxima(obs, F.lit(90.0)), 4 * HOUR)
    return _round(windows.peak_timing_error(pred, op), "obs_peak")


@query(
    "e14_seasonal_month",
    """WITH m AS (SELECT o_orderpriority, month(o_orderdate) AS month, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, CAST(month AS INTEGER) AS month, """ + s6("mean") + " AS mean, " + s6("mean - avg(mean) OVER (PARTITION BY o_orderpriority)") + " AS anomaly FROM m",
)
def seasonal_month(t):
    return _round(windows.seasonal_anomaly(t.orders, "month", ("o_orderpriority",), "o_orderdate", "o_totalprice"), "mean", "anomaly")


@query(
    "e14_seasonal_hour",
    f"WITH {READINGS}, m AS (SELECT series_id, hour(ts) AS hour, avg(value) AS mean FROM readings GROUP BY 1, 2) SELECT series_id, CAST(hour AS INTEGER) AS hour, {s6('mean')} AS mean, {s6('mean - avg(mean) OVER (PARTITION BY series_id)')} AS anomaly FROM m",
)
def seasonal_hour(t):
    return _round(windows.seasonal_anomaly(readings(t), "hour"), "mean", "anomaly")


@query("e14_monthly_rain", f"SELECT o_orderpriority, CAST(month(o_orderdate) AS INTEGER) AS month, {s6('avg(o_totalprice) * 24 * 30')} AS rain_mm FROM orders GROUP BY 1, 2")
def monthly_rain(t):
    return _round(windows.monthly_rain(t.orders, ("o_orderpriority",), "o_orderdate", "o_totalprice"), "rain_mm")


@query(
    "e15_exceedance_curve",
    f"""WITH {READINGS}, c AS (SELECT series_id, value, count(*) AS n_equal FROM readings GROUP BY 1, 2),
r AS (SELECT *, CAST(sum(n_equal) OVER (PARTITION BY series_id ORDER BY value DESC) AS BIGINT) AS last_rank, CAST(sum(n_equal) OVER (PARTITION BY series_id) AS BIGINT) AS n FROM c)
SELECT series_id, value, n_equal, last_rank - n_equal + 1 AS first_rank, last_rank, {s6('last_rank / n * 100')} AS exceedance_pct FROM r""",
)
def exceedance_curve(t):
    return _round(windows.exceedance_curve(readings(t)), "exceedance_pct")


@query(
    "e6_climatology_anomaly",
    f"""WITH d AS (SELECT l_returnflag AS cell, l_shipdate AS ts, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
c AS (SELECT cell, dayofyear(ts) AS doy, avg(v) AS m FROM d GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY doy) AS pos, count(*) OVER (PARTITION BY cell) AS n FROM c),
w AS (SELECT cell, doy, pos AS ps, m, true AS own FROM p UNION ALL SELECT cell, doy, pos + n, m, false FROM p WHERE pos <= 7 UNION ALL SELECT cell, doy, pos - n, m, false FROM p WHERE pos > n - 7),
s AS (SELECT cell, doy, own, avg(m) OVER (PARTITION BY cell ORDER BY ps ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS clim FROM w)
SELECT d.cell, d.ts, CAST(s.doy AS INTEGER) AS doy, {s6('clim')} AS climatology, {s6('v - clim')} AS anomaly FROM d JOIN s ON s.cell = d.cell AND s.own AND s.doy = dayofyear(d.ts)""",
)
def climatology_anomaly(t):
    d = t.lineitem.groupBy(F.col("l_returnflag").alias("cell"), F.col("l_shipdate").alias("ts")).agg(F.avg("l_quantity").alias("v"))
    out = windows.climatology_anomaly(d, ("cell",), "ts", "v")
    return _round(out, "climatology", "anomaly").select("cell", "ts", "doy", "climatology", "anomaly")


RATES = f"""{SLOTS},
rain AS (SELECT series_id, ts, coalesce(value, 0) AS v FROM grid), prm AS (SELECT series_id, 2 + length(series_id) % 4 AS tc FROM series),
wet AS (SELECT series_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series_id ORDER BY ts) <= 7200000000 THEN 0 ELSE 1 END AS fresh FROM rain WHERE v > 100),
ev AS (SELECT series_id, min(ts) AS t0 FROM (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY ts) AS g FROM wet) GROUP BY series_id, g),
st AS (SELECT series_id, ts, v * 0.01::DOUBLE + (epoch_us(ts) // 900000000) % 96 * 0.02::DOUBLE AS h FROM rain),
tot AS (SELECT e.series_id, e.t0, any_value(p.tc) AS tc, sum(r.v) AS total FROM ev e JOIN prm p USING (series_id) JOIN rain r ON r.series_id = e.series_id AND r.ts >= e.t0 AND r.ts < e.t0 + p.tc * INTERVAL 15 MINUTE GROUP BY 1, 2),
pk AS (SELECT t.series_id, t.t0, any_value(total) AS total, avg(s.h) FILTER (WHERE s.ts < t.t0) AS base, max(s.h) FILTER (WHERE s.ts >= t.t0 + t.tc * INTERVAL 15 MINUTE) AS peak
  FROM tot t JOIN st s ON s.series_id = t.series_id AND s.ts >= t.t0 - INTERVAL 1 HOUR AND s.ts < t.t0 + 3 * t.tc * INTERVAL 15 MINUTE GROUP BY 1, 2),
rt AS (SELECT series_id, (peak - base) / total AS rate FROM pk WHERE total >= 50 AND (peak - base) / total > 0),
med AS (SELECT series_id, count(*) AS n_rates, quantile_cont(rate, 0.5) AS m FROM rt GROUP BY 1)"""


def _response(t):
    g = grid(t)
    rain = g.withColumn("value", F.coalesce("value", F.lit(0.0)))
    slot_no = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / STEP)
    stage = rain.withColumn("value", F.col("value") * 0.01 + F.pmod(slot_no, F.lit(96)) * 0.02)
    params = readings(t).select("series_id").distinct().withColumn("tc_steps", 2 + F.pmod(F.length("series_id"), F.lit(4)))
    return windows.response_rates(rain, stage, params, wet=100.0, min_total=50.0, min_rates=5, min_wet=3)


@query("e11_response_rates", f"WITH {RATES} SELECT p.series_id, coalesce(n_rates, 0) AS n_rates, CASE WHEN n_rates >= 5 THEN {s6('m')} END AS peak_rate FROM prm p LEFT JOIN med USING (series_id)")
def response_rates(t):
    return _round(_response(t), "peak_rate")


@query(
    "e11_inherited_rates",
    f"""WITH b AS (SELECT s_suppkey AS node, abs(s_acctbal) / 10 + 1 AS area, s_suppkey % 13 = 5 AS tidal, s_suppkey % 11 = 3 AS reservoir, CASE WHEN s_suppkey % 3 = 0 THEN 0.002::DOUBLE + (s_suppkey % 40) * 0.001::DOUBLE END AS pr FROM supplier),
c AS (SELECT *, CASE WHEN tidal THEN 0.003::DOUBLE WHEN reservoir THEN 0.005::DOUBLE ELSE pr END AS r0 FROM b),
d AS (SELECT u.node, arg_min({{'r': k.r0, 'a': k.area}}, {{'d': abs(k.node - u.node), 'o': k.node}}) AS donor FROM c u, c k WHERE u.r0 IS NULL AND k.r0 IS NOT NULL GROUP BY 1),
e AS (SELECT c.*, coalesce(r0, least(greatest(donor.r * sqrt(greatest(donor.a, 0.01) / greatest(area, 0.01)), 0.001), 0.05), 0.005) AS raw FROM c LEFT JOIN d USING (node))
SELECT node, {s6('CASE WHEN tidal OR reservoir THEN raw ELSE least(greatest(raw, CASE WHEN area < 25 THEN 0.015 WHEN area < 100 THEN 0.010 ELSE 0.005 END), 0.030) END')} AS rate FROM e""",
)
def inherited_rates(t):
    from .base import nodes

    k = F.col("node")
    n = nodes(t).select("node", "area_km2", "is_tidal", "is_reservoir", F.when(F.pmod(k, F.lit(3)) == 0, 0.002 + F.pmod(k, F.lit(40)) * 0.001).alias("peak_rate"))
    return windows.inherit_rates(n).select("node", r6("rate").alias("rate"))


@query(
    "e20_training_curves",
    f"""WITH h AS (SELECT event_type AS model, CAST(date_part('day', ts) AS INTEGER) AS epoch, avg(value) AS val_loss, CASE WHEN event_type = 'click' THEN avg(value) / 100 END AS val_nse FROM events GROUP BY 1, 2),
b AS (SELECT *, min(val_loss) OVER (PARTITION BY model) AS lo, max(val_loss) OVER (PARTITION BY model) AS hi FROM h)
SELECT model, epoch, {s6('coalesce(val_nse, CASE WHEN hi > lo THEN 1 - (val_loss - lo) / (hi - lo) ELSE 0 END)')} AS score, val_nse IS NULL AS is_proxy FROM b""",
)
def training_curves(t):
    from rivulet.operators import comparison

    h = t.events.groupBy(F.col("event_type").alias("model"), F.dayofmonth("ts").alias("epoch")).agg(F.avg("value").alias("val_loss"))
    h = h.withColumn("val_nse", F.when(F.col("model") == "click", F.col("val_loss") / 100))
    return _round(comparison.training_curve(h, ("model",), ("val_nse",), "val_loss"), "score").select("model", "epoch", "score", "is_proxy")


@query(
    "k48_histogram",
    f"""WITH {READINGS}, b AS (SELECT series_id, min(value) AS lo, max(value) AS hi, count(*) AS n FROM readings GROUP BY 1),
x AS (SELECT series_id, least(CAST(floor((value - lo) / ((hi - lo) / 80)) AS BIGINT), 79) AS bin, lo, hi, n FROM readings JOIN b USING (series_id))
SELECT series_id, bin, count(*) AS n, {s6('count(*) / (any_value(n) * ((any_value(hi) - any_value(lo)) / 80))')} AS density FROM x GROUP BY 1, 2""",
)
def histogram(t):
    from rivulet.operators import stats

    return _round(stats.histogram(readings(t), ("series_id",), "value", 80), "density")


@query("k62_event_report", f"WITH {HOURLY} SELECT series_id, ts, {s6('value')} AS value FROM hourly WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def event_report(t):
    return _round(timegrid.clip_period(grid(t, "1 hour"), "2024-01-10 00:00:00", "2024-01-12 12:00:00"), "value").select("series_id", "ts", "value")
