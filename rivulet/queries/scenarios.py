"""Scenario windows and scores. A window is 104 steps of the common time axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.operators import comparison, scenarios, scores, timegrid, windows
from rivulet.plans.fixpoint import cut
from rivulet.plans.ranks import neighbours_in_order
from rivulet.plans.timechunks import HOUR, STEP, fdiv, micros

from .base import FORECAST, SLOTS, forecast, grid, query, r6, s6
from .events import shifted_forecast, timing_ctes


def _round(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


SC = f"""{FORECAST}, lo AS (SELECT min(epoch_us(ts)) AS lo FROM events),
sc AS (SELECT f.model, f.seed, f.horizon, f.node % 10 AS node, f.pred, f.target, e.event_type AS scenario, (epoch_us(f.ts) - lo) // 900000000 // 104 AS window_id, (epoch_us(f.ts) - lo) // 900000000 % 104 AS local_step,
  (epoch_us(f.ts) - lo) // 900000000 // 104 % 3 AS realization_id FROM forecast f JOIN events e ON e.event_id = f.row_id, lo)"""


def scenario_forecast(t):
    f = forecast(t).join(t.events.select(F.col("event_id").alias("row_id"), F.col("event_type").alias("scenario")), "row_id")
    lo = t.events.agg(micros(F.min("ts"))).scalar()
    at = fdiv(micros("ts") - F.col("_lo"), STEP)
    f = f.withColumn("_lo", lo).withColumn("_at", at)
    return f.select(
        "model", "seed", "horizon", F.pmod("node", F.lit(10)).alias("node"), "pred", "target", "scenario",
        fdiv(F.col("_at"), 104).alias("window_id"), F.pmod("_at", F.lit(104)).alias("local_step"), F.pmod(fdiv(F.col("_at"), 104), F.lit(3)).alias("realization_id"))


@query(
    "k37_phase_scores",
    f"""WITH {SC}, ru AS (SELECT DISTINCT event_type AS scenario, user_id % 10 AS node, CASE WHEN user_id % 10 < 6 THEN 'arrival' ELSE 'leakage' END AS metric, CASE WHEN user_id % 10 < 6 THEN 'rmse' ELSE 'bias' END AS kind, 42 AS a, CASE WHEN user_id % 10 < 6 THEN 54 ELSE 104 END AS z FROM events),
h AS (SELECT scenario, model, horizon, metric, kind, count(*) AS n, sqrt(avg((pred - target)^2)) AS r, avg(pred - target) AS b FROM sc JOIN ru USING (scenario, node) WHERE local_step >= a AND local_step < z GROUP BY 1, 2, 3, 4, 5)
SELECT scenario, model, horizon, metric, n, CASE WHEN n >= 5 THEN CASE WHEN kind = 'rmse' THEN {s6('r')} ELSE {s6('b')} END END AS value FROM h""",
)
def phase_scores(t):
    near = F.col("node") < 6
    rules = t.events.select(F.col("event_type").alias("scenario"), F.pmod("user_id", F.lit(10)).alias("node")).distinct().select(
        "scenario", "node", F.when(near, "arrival").otherwise("leakage").alias("metric"), F.when(near, "rmse").otherwise("bias").alias("kind"), F.lit(42).alias("step_from"), F.when(near, 54).otherwise(104).alias("step_to"))
    return _round(scores.phase_scores(scenario_forecast(t), rules, ("scenario", "model", "horizon")), "value")


@query(
    "k38_outage_scores",
    f"""WITH {SC}, o AS (SELECT DISTINCT (s_suppkey % 3) AS realization_id, s_suppkey % 10 AS node, 8 + (s_suppkey % 3) * 10 AS dur FROM supplier WHERE s_suppkey % 10 IN (1, 4, 7)),
p AS (SELECT sc.*, o.dur IS NOT NULL AND local_step < 36 + dur AS failed FROM sc LEFT JOIN o USING (realization_id, node) WHERE local_step >= 36),
r AS (SELECT model, seed, horizon, sqrt(avg((pred - target)^2)) AS rr FROM forecast GROUP BY 1, 2, 3),
a AS (SELECT model, seed, horizon, count(*) AS n, sqrt(avg((pred - target)^2)) AS ra, count(*) FILTER (WHERE failed) AS nf, sqrt(avg((pred - target)^2) FILTER (WHERE failed)) AS rf FROM p GROUP BY 1, 2, 3)
SELECT model, seed, horizon, {s6('ra')} AS rmse_all, nf AS n_failed, CASE WHEN nf >= 5 THEN {s6('rf')} END AS rmse_failed, {s6('rr')} AS real_rmse, {s6('ra / rr')} AS ratio_all, CASE WHEN nf >= 5 THEN {s6('rf / rr')} END AS ratio_failed FROM a JOIN r USING (model, seed, horizon)""",
)
def outage_scores(t):
    o = t.supplier.where(F.pmod("s_suppkey", F.lit(10)).isin(1, 4, 7)).select(
        F.pmod("s_suppkey", F.lit(3)).alias("realization_id"), F.pmod("s_suppkey", F.lit(10)).alias("node"), (F.pmod("s_suppkey", F.lit(3)) * 10 + 8).alias("duration_steps")).distinct()
    keys = ("model", "seed", "horizon")
    out = scores.outage_scores(scenario_forecast(t), o, scores.pooled_scores(forecast(t), keys), keys, onset=36)
    return _round(out, "rmse_all", "rmse_failed", "real_rmse", "ratio_all", "ratio_failed")


@query(
    "k39_break_scores",
    f"""WITH {SC}, b AS (SELECT n_nationkey AS realization_id, 40 + n_nationkey * 3 AS brk FROM nation), j AS (SELECT sc.*, local_step < brk AS pre FROM sc JOIN b USING (realization_id)),
a AS (SELECT model, horizon, scenario, sqrt(avg((pred - target)^2) FILTER (WHERE pre)) AS p, sqrt(avg((pred - target)^2) FILTER (WHERE NOT pre)) AS q FROM j GROUP BY 1, 2, 3)
SELECT model, horizon, scenario, {s6('p')} AS rmse_pre, {s6('q')} AS rmse_post, {s6('q / p')} AS post_pre_ratio FROM a""",
)
def break_scores(t):
    b = t.nation.select(F.col("n_nationkey").cast("long").alias("realization_id"), (F.col("n_nationkey") * 3 + 40).alias("break_step"))
    return _round(scores.break_scores(scenario_forecast(t), b, ("model", "horizon", "scenario")), "rmse_pre", "rmse_post", "post_pre_ratio")


@query(
    "k40_realization_scores",
    f"WITH {SC} SELECT model, scenario, realization_id, count(*) AS n, {s6('1 - sum((pred - target)^2) / (var_pop(target) * count(*))')} AS nse, {s6('sqrt(avg((pred - target)^2))')} AS rmse FROM sc GROUP BY 1, 2, 3 HAVING count(*) >= 5",
)
def realization_scores(t):
    return _round(scores.realization_scores(scenario_forecast(t), ("model", "scenario")), "nse", "rmse")


# ------------------------------------------------------------ window scores
WIN = f"""{SLOTS}, wv AS (SELECT series_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM grid)) // 900000000 // 104 AS window_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM grid)) // 900000000 % 104 AS local_step, value FROM grid WHERE value IS NOT NULL)"""


def window_values(t, series):
    g = grid(t)
    return g.withColumn("idx", timegrid.step_index(t.events)).where((F.col("series_id") == series) & F.col("value").isNotNull()).select(
        fdiv(F.col("idx"), 104).alias("window_id"), F.pmod("idx", F.lit(104)).alias("local_step"), "value")


def _stat(name, series, onset, end):
    return f"""{name} AS (SELECT window_id, CASE WHEN n >= 3 AND hp IS NOT NULL THEN greatest(hp - m, m - lp) / (s + 1e-6) ELSE 0 END AS snr, CASE WHEN n < 3 THEN 0.5 WHEN ho IS NULL THEN 1 ELSE 1 / (1 + greatest(ho - m, m - lo) / (s + 1e-6)) END AS clean, s AS pre_std FROM (
  SELECT window_id, count(*) FILTER (WHERE local_step < {onset}) AS n, avg(value) FILTER (WHERE local_step < {onset}) AS m, stddev_pop(value) FILTER (WHERE local_step < {onset}) AS s, max(value) FILTER (WHERE local_step >= {onset} AND local_step < {end}) AS hp, min(value) FILTER (WHERE local_step >= {onset} AND local_step < {end}) AS lp,
  max(value) FILTER (WHERE local_step >= {end}) AS ho, min(value) FILTER (WHERE local_step >= {end}) AS lo FROM wv WHERE series_id = '{series}' GROUP BY 1))"""


@query("e21_event_score", f"WITH {WIN}, {_stat('a', 'click', 34, 64)} SELECT window_id, {s6('snr')} AS signal_to_noise, {s6('clean')} AS cleanliness, {s6('snr * clean')} AS score FROM a")
def event_score(t):
    return _round(scenarios.event_score(window_values(t, "click"), 34), "signal_to_noise", "cleanliness", "score")


@query("e21_best_windows", f"WITH {WIN}, {_stat('a', 'click', 34, 64)} SELECT window_id, {s6('snr * clean')} AS score FROM a WHERE snr * clean IS NOT NULL ORDER BY snr * clean DESC, window_id LIMIT 5")
def best_windows(t):
    return _round(scenarios.best_windows(scenarios.event_score(window_values(t, "click"), 34).select("window_id", "score")), "score")


@query(
    "e21_outage_score",
    f"""WITH {WIN}, b AS (SELECT window_id, count(*) FILTER (WHERE local_step < 36) AS n, stddev_pop(value) FILTER (WHERE local_step < 36) AS s, arg_max(value, local_step) FILTER (WHERE local_step < 36) AS fz FROM wv WHERE series_id = 'view' GROUP BY 1)
SELECT w.window_id, {s6('CASE WHEN any_value(n) >= 3 THEN avg(abs(value - fz)) / (any_value(s) + 1e-6) ELSE 0 END')} AS score FROM wv w JOIN b USING (window_id) WHERE series_id = 'view' AND local_step >= 36 GROUP BY 1""",
)
def outage_score(t):
    return _round(scenarios.outage_score(window_values(t, "view"), 36), "score")


@query(
    "e21_release_score",
    f"""WITH {WIN}, {_stat('a', 'error', 36, 104)}, f AS (SELECT window_id, stddev_pop(value) FILTER (WHERE local_step < 36) + 1e-6 AS x, stddev_pop(value) FILTER (WHERE local_step >= 36) + 1e-6 AS y FROM wv WHERE series_id = 'signup' GROUP BY 1)
SELECT window_id, {s6('snr / (1 + greatest(0, y / x - 1))')} AS score FROM a JOIN f USING (window_id)""",
)
def release_score(t):
    return _round(scenarios.release_score(window_values(t, "error"), window_values(t, "signup"), 36), "score")


@query(
    "e21_blockage_score",
    f"""WITH {WIN}, {_stat('a', 'error', 36, 104)}, {_stat('b', 'signup', 36, 104)}, {_stat('c', 'view', 36, 104)} SELECT a.window_id, {s6('(a.snr + b.snr) * (1 + c.pre_std) * a.clean')} AS score FROM a JOIN b USING (window_id) JOIN c USING (window_id)""",
)
def blockage_score(t):
    return _round(scenarios.blockage_score(window_values(t, "error"), window_values(t, "signup"), window_values(t, "view"), 36), "score")


# The scores above are of one or two fixed series; these are of every window of every series.
BY = ("series_id", "window_id")
#: Roles over all series: in the ring of sorted names the one before a series is upstream of it, the one after it downstream.
RING = "ring AS (SELECT series_id, coalesce(lag(series_id) OVER (ORDER BY series_id), max(series_id) OVER ()) AS up, coalesce(lead(series_id) OVER (ORDER BY series_id), min(series_id) OVER ()) AS down FROM series)"


def ring(t) -> DataFrame:
    names = neighbours_in_order(t.events.select(F.col("event_type").alias("series_id")), "series_id")
    ends = names.agg(F.min("series_id").alias("lo"), F.max("series_id").alias("hi"))
    return names.select("series_id", F.coalesce("before", ends.select("hi").scalar()).alias("up"), F.coalesce("after", ends.select("lo").scalar()).alias("down"))


def all_window_values(t) -> DataFrame:
    idx = timegrid.step_index(t.events)
    return grid(t).withColumn("idx", idx).where("value is not null").select("series_id", fdiv(F.col("idx"), 104).alias("window_id"), F.pmod("idx", F.lit(104)).alias("local_step"), "value")


def _as_role(t, values: DataFrame, role: str) -> DataFrame:
    """Values of the series in that role, under the name of the series that they serve."""
    return values.withColumnRenamed("series_id", role).join(ring(t).select("series_id", role), role).drop(role)


def _stats(onset, end):
    return f"""a AS (SELECT series_id, window_id, CASE WHEN n >= 3 AND hp IS NOT NULL THEN greatest(hp - m, m - lp) / (s + 1e-6) ELSE 0 END AS snr, CASE WHEN n < 3 THEN 0.5 WHEN ho IS NULL THEN 1 ELSE 1 / (1 + greatest(ho - m, m - lo) / (s + 1e-6)) END AS clean, s AS pre_std FROM (
  SELECT series_id, window_id, count(*) FILTER (WHERE local_step < {onset}) AS n, avg(value) FILTER (WHERE local_step < {onset}) AS m, stddev_pop(value) FILTER (WHERE local_step < {onset}) AS s, max(value) FILTER (WHERE local_step >= {onset} AND local_step < {end}) AS hp, min(value) FILTER (WHERE local_step >= {onset} AND local_step < {end}) AS lp,
  max(value) FILTER (WHERE local_step >= {end}) AS ho, min(value) FILTER (WHERE local_step >= {end}) AS lo FROM wv GROUP BY 1, 2))"""


@query("e21_event_score_all", f"WITH {WIN}, {_stats(34, 64)} SELECT series_id, window_id, {s6('snr')} AS signal_to_noise, {s6('clean')} AS cleanliness, {s6('snr * clean')} AS score FROM a")
def event_score_all(t):
    return _round(scenarios.event_score(all_window_values(t), 34, keys=BY), "signal_to_noise", "cleanliness", "score")


@query("e21_best_windows_all", f"WITH {WIN}, {_stats(34, 64)} SELECT series_id, window_id, {s6('snr * clean')} AS score FROM a WHERE snr * clean IS NOT NULL ORDER BY snr * clean DESC, series_id, window_id LIMIT 5")
def best_windows_all(t):
    return _round(scenarios.best_windows(scenarios.event_score(all_window_values(t), 34, keys=BY).select(*BY, "score"), keys=BY), "score")


@query(
    "e21_outage_score_all",
    f"""WITH {WIN}, b AS (SELECT series_id, window_id, count(*) FILTER (WHERE local_step < 36) AS n, stddev_pop(value) FILTER (WHERE local_step < 36) AS s, arg_max(value, local_step) FILTER (WHERE local_step < 36) AS fz FROM wv GROUP BY 1, 2)
SELECT series_id, window_id, {s6('CASE WHEN any_value(n) >= 3 THEN avg(abs(value - fz)) / (any_value(s) + 1e-6) ELSE 0 END')} AS score FROM wv JOIN b USING (series_id, window_id) WHERE local_step >= 36 GROUP BY 1, 2""",
)
def outage_score_all(t):
    return _round(scenarios.outage_score(all_window_values(t), 36, keys=BY), "score")


@query(
    "e21_release_score_all",
    f"""WITH {WIN}, {RING}, {_stats(36, 104)}, f AS (SELECT r.series_id, w.window_id, stddev_pop(value) FILTER (WHERE local_step < 36) + 1e-6 AS x, stddev_pop(value) FILTER (WHERE local_step >= 36) + 1e-6 AS y FROM wv w JOIN ring r ON r.up = w.series_id GROUP BY 1, 2)
SELECT series_id, window_id, {s6('snr / (1 + greatest(0, y / x - 1))')} AS score FROM a JOIN f USING (series_id, window_id)""",
)
def release_score_all(t):
    w = all_window_values(t)
    return _round(scenarios.release_score(w, _as_role(t, w, "up"), 36, keys=BY), "score")


@query(
    "e21_blockage_score_all",
    f"""WITH {WIN}, {RING}, {_stats(36, 104)} SELECT a.series_id, a.window_id, {s6('(a.snr + b.snr) * (1 + c.pre_std) * a.clean')} AS score FROM a JOIN ring r ON r.series_id = a.series_id JOIN a b ON b.series_id = r.up AND b.window_id = a.window_id JOIN a c ON c.series_id = r.down AND c.window_id = a.window_id""",
)
def blockage_score_all(t):
    w = all_window_values(t)
    return _round(scenarios.blockage_score(w, _as_role(t, w, "up"), _as_role(t, w, "down"), 36, keys=BY), "score")


# -------------------------------------------------------- window selection
def _network_grid(t):
    g = grid(t).withColumn("value", F.coalesce("value", F.lit(20.0)))
    return g.select(F.col("series_id").alias("node"), "ts", F.least(F.col("value") / 60, F.lit(1.0)).alias("sat"), (F.col("value") / 100).alias("rain"), (F.col("value") / 50).alias("stage"))


def _bankfull(t):
    return t.events.select(F.col("event_type").alias("node")).distinct().withColumn("bankfull", F.length("node") * 0.9 + 5)


CAND = f"""WITH RECURSIVE {SLOTS}, ng AS (SELECT series_id AS node, ts, CAST((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM grid)) // 900000000 AS BIGINT) AS idx, least(coalesce(value, 20) / 60, 1) AS sat, coalesce(value, 20) / 50 AS stage, length(series_id) * 0.9::DOUBLE + 5 AS bf FROM grid),
per AS (SELECT ts, idx, sum(sat) AS ss, sum(sat * sat) AS sq, count(*) AS n, max(CASE WHEN abs(stage) > greatest(bf, 0.3) * 0.4::DOUBLE THEN 1 ELSE 0 END) AS high FROM ng GROUP BY 1, 2),
cd AS (SELECT ts, idx, sum(ss) OVER w / sum(n) OVER w AS wetness, max(high) OVER w = 0 AND sum(ss) OVER w / sum(n) OVER w BETWEEN 0.3 AND 0.6 AS ok FROM per WINDOW w AS (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING)),
nn AS (SELECT max(idx) + 1 AS n FROM per)"""


@query("d16_window_candidates", f"{CAND} SELECT ts, idx, {s6('wetness')} AS wetness, ok FROM cd")
def window_candidates(t):
    return _round(scenarios.window_candidates(_network_grid(t), _bankfull(t), sat_min=0.3, sat_max=0.6, source=t.events), "wetness")


@query(
    "d16_select_windows",
    f"""{CAND}, walk(idx) AS (SELECT CAST(floor(n * 0.5::DOUBLE) AS BIGINT) FROM nn UNION ALL SELECT w.idx + CASE WHEN c.ok THEN 32 ELSE 48 END FROM walk w JOIN cd c ON c.idx = w.idx, nn WHERE w.idx < nn.n - 104)
SELECT c.idx, c.ts FROM walk w JOIN cd c ON c.idx = w.idx, nn WHERE c.ok AND c.idx < nn.n - 104""",
)
def select_windows(t):
    g = _network_grid(t)
    c = scenarios.window_candidates(g, _bankfull(t), sat_min=0.3, sat_max=0.6, source=t.events)
    return scenarios.select_windows(c, timegrid.n_steps(t.events), search_from=0.5)


@query(
    "d17_high_stage_windows",
    f"""{CAND}, tp AS (SELECT node, ts, idx, bf, max(stage) OVER (PARTITION BY node ORDER BY idx ROWS BETWEEN 32 FOLLOWING AND 55 FOLLOWING) AS top FROM ng)
SELECT idx, ts, count(*) FILTER (WHERE top > 0.5::DOUBLE * bf) AS n_exceeding FROM tp, nn WHERE idx >= floor(n * 0.85::DOUBLE) AND idx < n - 104 AND (idx - CAST(floor(n * 0.85::DOUBLE) AS BIGINT)) % 16 = 0 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE top > 0.5::DOUBLE * bf) >= 2""",
)
def high_stage_windows(t):
    return scenarios.high_stage_windows(_network_grid(t), _bankfull(t), min_nodes=2, source=t.events)


# ---------------------------------------------------- records without SQL
def _timing(t, keys=("series_id",)):
    obs, pred = shifted_forecast(t)
    if "window_id" in keys:
        lo = F.lit(obs.agg(micros(F.min("ts"))).first()[0]).cast("long")  # a value: as a subquery it would be planned again wherever the window is used
        tag = lambda d: d.withColumn("window_id", fdiv(micros("ts") - lo, 104 * STEP))
        obs, pred = tag(obs), tag(pred)
    op = windows.thin_peaks(windows.local_maxima(obs, F.lit(90.0), keys), 4 * HOUR, keys)
    return scenarios.timing_summary(windows.peak_timing_error(pred, op, keys), keys)


def _gridded_forecast(t):
    obs, pred = shifted_forecast(t)
    both = obs.select("series_id", "ts", F.col("value").alias("target")).join(pred.select("series_id", "ts", F.col("value").alias("pred")), ["series_id", "ts"])
    return both.withColumn("valid", F.col("target").isNotNull()).withColumn("node", F.col("series_id"))


@query(
    "k15_extended_record",
    f"""WITH RECURSIVE {SLOTS}, {timing_ctes(False)}, tq AS (SELECT k, avg(abs(error_h)) AS m, quantile_cont(abs(error_h), 0.5) AS md, count(*) AS n FROM tm WHERE error_h IS NOT NULL GROUP BY 1),
f AS (SELECT o.series_id, o.value AS t, p.value AS p FROM obs0 o JOIN pred0 p ON p.series_id = o.series_id AND p.ts = o.ts WHERE o.value IS NOT NULL), g AS (SELECT series_id, corr(p, t) AS r, stddev_pop(p) / stddev_pop(t) AS a, avg(p) / avg(t) AS b,
  count(*) FILTER (WHERE p >= 90 AND t >= 90) AS tp, count(*) FILTER (WHERE p >= 90 AND t < 90) AS fp, count(*) FILTER (WHERE p < 90 AND t >= 90) AS fn, count(*) FILTER (WHERE p < 90 AND t < 90) AS tn FROM f GROUP BY 1)
SELECT series_id, {s6('1 - sqrt(pow(r - 1, 2) + pow(a - 1, 2) + pow(b - 1, 2))')} AS kge, {s6('r')} AS r, {s6('a')} AS alpha, {s6('b')} AS beta, tp, fp, fn, tn, {s6('tp / (tp + fn + 1e-8)')} AS pod, {s6('fp / (tp + fp + 1e-8)')} AS far,
  {s6('m')} AS peak_timing_mean_hr, {s6('md')} AS peak_timing_median_hr, n AS peak_timing_n_events FROM g JOIN tq ON tq.k = series_id""",
)
def extended_record(t):
    f = _gridded_forecast(t)
    k = scores.kge(f, ("series_id",)).select("series_id", "kge", "r", "alpha", "beta")
    out = scenarios.extended_record(k, scores.pod_far(f, ("series_id",), F.lit(90.0)), _timing(t), ("series_id",))
    return _round(out, "kge", "r", "alpha", "beta", "pod", "far", "peak_timing_mean_hr", "peak_timing_median_hr")


@query(
    "k41_window_timing",
    f"""WITH RECURSIVE {SLOTS}, {timing_ctes(True)}, w AS (SELECT k, split_part(k, '#', 1) AS series_id, avg(abs(error_h)) AS m, quantile_cont(abs(error_h), 0.5) AS md, count(*) AS n FROM tm WHERE error_h IS NOT NULL GROUP BY 1, 2)
SELECT series_id, {s6('sum(m * n) / sum(n)')} AS timing_mean_h, CAST(sum(n) AS BIGINT) AS n_events, {s6('quantile_cont(md, 0.5)')} AS timing_median_h FROM w GROUP BY 1""",
)
def window_timing(t):
    return _round(scores.weighted_timing(_timing(t, ("series_id", "window_id")), ("series_id",)), "timing_mean_h", "timing_median_h")


@query(
    "k42_scenario_record",
    f"""WITH RECURSIVE {SLOTS}, {timing_ctes(True)}, w AS (SELECT k, split_part(k, '#', 1) AS scenario, avg(abs(error_h)) AS m, quantile_cont(abs(error_h), 0.5) AS md, count(*) AS n FROM tm WHERE error_h IS NOT NULL GROUP BY 1, 2),
wt AS (SELECT scenario, sum(m * n) / sum(n) AS tmean, CAST(sum(n) AS BIGINT) AS tn, quantile_cont(md, 0.5) AS tmed FROM w GROUP BY 1), {SC}, p AS (SELECT scenario, model, seed, horizon, 1 - sum((pred - target)^2) / (var_pop(target) * count(*)) AS nse, sqrt(avg((pred - target)^2)) AS rmse, count(*) FILTER (WHERE pred >= 1.2 AND target >= 1.2) AS tp, count(*) FILTER (WHERE pred >= 1.2 AND target < 1.2) AS fp, count(*) FILTER (WHERE pred < 1.2 AND target >= 1.2) AS fn FROM sc GROUP BY 1, 2, 3, 4),
r AS (SELECT model, seed, horizon, sqrt(avg((pred - target)^2)) AS real_rmse FROM forecast GROUP BY 1, 2, 3)
SELECT scenario, model, seed, horizon, {s6('nse')} AS nse_syn, {s6('rmse')} AS rmse_syn, {s6('tp / greatest(tp + fn, 1)')} AS pod_syn, {s6('fp / greatest(tp + fp, 1)')} AS far_syn, {s6('real_rmse')} AS real_rmse, {s6('rmse / real_rmse')} AS degradation_ratio,
  {s6('tmean')} AS peak_timing_mean_hr, {s6('tmed')} AS peak_timing_median_hr, coalesce(tn, 0) AS peak_timing_n_events FROM p JOIN r USING (model, seed, horizon) LEFT JOIN wt USING (scenario)""",
)
def scenario_record(t):
    f, keys = scenario_forecast(t), ("scenario", "model", "seed", "horizon")
    real = scores.pooled_scores(forecast(t), keys[1:])
    kinds = f.select("scenario").distinct()
    real = real.withColumn("scenario", F.explode(F.array(*[F.lit(k) for k in ("click", "view", "error", "purchase", "signup")]))).join(kinds, "scenario", "left_semi")
    timing = cut(scores.weighted_timing(_timing(t, ("series_id", "window_id")), ("series_id",)).withColumnRenamed("series_id", "scenario"))  # else the record's plan holds all of its passes
    out = scores.scenario_record(scores.pooled_scores(f, keys), scores.pod_far_unmasked(f, keys, F.lit(1.2)), real, keys, timing, ("scenario",))
    return _round(out, "nse_syn", "rmse_syn", "pod_syn", "far_syn", "real_rmse", "degradation_ratio", "peak_timing_mean_hr", "peak_timing_median_hr")


# -------------------------------------------------- excess against the flow
ROLES = f"""{SC}, ro AS (SELECT n_nationkey AS node, CASE WHEN n_regionkey < 2 THEN 'upstream' ELSE 'downstream' END AS role FROM nation),
rs AS (SELECT model, seed, horizon, sqrt(avg((pred - target)^2) FILTER (WHERE role = 'downstream')) AS d, avg(pred - target) FILTER (WHERE role = 'upstream') AS u FROM sc JOIN ro USING (node) WHERE local_step >= 36 AND pred - target IS NOT NULL GROUP BY 1, 2, 3)"""


def _role_runs(t):
    roles = t.nation.select(F.col("n_nationkey").cast("long").alias("node"), F.when(F.col("n_regionkey") < 2, "upstream").otherwise("downstream").alias("role"))
    return comparison.role_scores(scenario_forecast(t), roles, ("model", "seed", "horizon"), 36)


_SPREAD = f"{s6('avg(d)')} AS downstream_rmse_mean, {s6('stddev_samp(d)')} AS downstream_rmse_std, {s6('avg(u)')} AS upstream_bias_mean, {s6('stddev_samp(u)')} AS upstream_bias_std"
_COLUMNS = ("downstream_rmse_mean", "downstream_rmse_std", "upstream_bias_mean", "upstream_bias_std")


@query("k36_leakage_table", f"WITH {ROLES} SELECT model, horizon, {_SPREAD} FROM rs GROUP BY 1, 2")
def leakage_table(t):
    return _round(comparison.leakage_table(_role_runs(t)), *_COLUMNS)


@query("k36_blockage_table", f"WITH {ROLES}, b AS (SELECT model, avg(d) AS dm, stddev_samp(d) AS ds, avg(u) AS um, stddev_samp(u) AS us, model = 'm_a' AS rev FROM rs GROUP BY 1) SELECT model, {s6('dm')} AS downstream_rmse_mean, {s6('ds')} AS downstream_rmse_std, {s6('um')} AS upstream_bias_mean, {s6('us')} AS upstream_bias_std, rev AS reverse_path, {s6('um - (SELECT avg(um) FROM b WHERE NOT rev)')} AS bias_minus_others FROM b")
def blockage_table(t):
    return _round(comparison.blockage_table(_role_runs(t), ("m_a",)), *_COLUMNS, "bias_minus_others")
