"""Verification scores over the forecast table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import scores, timegrid

from .base import FORECAST, SLOTS, forecast, grid, query, r6, s6

RUN = ("model", "seed", "horizon")
NODE_AGG = f"""node_agg AS (SELECT model, seed, horizon, node, count(*) AS n, sqrt(avg((pred - target)^2)) AS rmse, avg(abs(pred - target)) AS mae,
  1 - sum((pred - target)^2) / greatest(var_pop(target) * count(*), 1e-8) AS nse, avg(pred - target) AS mbe FROM forecast WHERE valid GROUP BY 1, 2, 3, 4)"""


def _round(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


@query(
    "k8_mean_over_nodes",
    f"WITH {FORECAST}, {NODE_AGG} SELECT model, seed, horizon, {s6('avg(rmse)')} AS rmse, {s6('avg(mae)')} AS mae, {s6('avg(nse)')} AS nse, {s6('avg(mbe)')} AS mbe FROM node_agg WHERE n >= 2 GROUP BY 1, 2, 3",
)
def mean_over_nodes(t):
    return _round(scores.mean_over_nodes(forecast(t), RUN), "rmse", "mae", "nse", "mbe")


@query(
    "k9_node_scores",
    f"""WITH {FORECAST}, {NODE_AGG}, k AS (SELECT DISTINCT model, seed, horizon, node FROM forecast)
SELECT model, seed, horizon, node, CASE WHEN n >= 2 THEN {s6('rmse')} END AS rmse, CASE WHEN n >= 2 THEN {s6('mae')} END AS mae, CASE WHEN n >= 2 THEN {s6('nse')} END AS nse,
  CASE WHEN n >= 2 THEN {s6('mbe')} END AS mbe, CASE WHEN n >= 2 THEN n ELSE 0 END AS n_valid FROM k LEFT JOIN node_agg USING (model, seed, horizon, node)""",
)
def node_scores(t):
    return _round(scores.node_scores(forecast(t), (*RUN, "node")), "rmse", "mae", "nse", "mbe")


@query(
    "k10_step_scores",
    f"""WITH {FORECAST}, a AS (SELECT model, horizon, step, node, count(*) AS n, sqrt(avg((pred - target)^2)) AS rmse, avg(abs(pred - target)) AS mae,
  1 - sum((pred - target)^2) / greatest(var_pop(target) * count(*), 1e-8) AS nse, avg(pred - target) AS mbe FROM forecast WHERE valid GROUP BY 1, 2, 3, 4)
SELECT model, horizon, step, {s6('avg(rmse)')} AS rmse, {s6('avg(mae)')} AS mae, {s6('avg(nse)')} AS nse, {s6('avg(mbe)')} AS mbe, step * 15 AS lead_min FROM a WHERE n >= 2 GROUP BY 1, 2, 3""",
)
def step_scores(t):
    return _round(scores.step_scores(forecast(t), ("model", "horizon")), "rmse", "mae", "nse", "mbe")


@query(
    "k11_masked_mse",
    f"""WITH {FORECAST}, m AS (SELECT *, CASE WHEN valid THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v, (pred - target)^2 AS e2, step / 2.5::DOUBLE AS w FROM forecast)
SELECT model, seed, horizon, {s6('sum(e2 * v) / greatest(sum(v), 1)')} AS mse, {s6('sum(e2 * v * w) / greatest(sum(v * w), 1)')} AS weighted_mse FROM m GROUP BY 1, 2, 3""",
)
def masked_mse(t):
    return _round(scores.masked_mse(forecast(t), RUN, 4), "mse", "weighted_mse")


KGE = f"""kge_raw AS (SELECT model, seed, horizon, node, count(*) AS n, corr(pred, target) AS r0, stddev_pop(pred) AS sp, stddev_pop(target) AS st, avg(pred) AS mp, avg(target) AS mt FROM forecast WHERE valid GROUP BY 1, 2, 3, 4),
kge_parts AS (SELECT model, seed, horizon, node, n, CASE WHEN n >= 10 AND NOT isnan(r0) THEN r0 END AS r, CASE WHEN n >= 10 AND st > 1e-10 THEN sp / st END AS alpha, CASE WHEN n >= 10 AND abs(mt) > 0.9 THEN mp / mt END AS beta FROM kge_raw),
kge AS (SELECT *, 1 - sqrt((r - 1)^2 + (alpha - 1)^2 + (beta - 1)^2) AS kge FROM kge_parts)"""


@query("k12_kge", f"WITH {FORECAST}, {KGE} SELECT model, seed, horizon, node, n, {s6('r')} AS r, {s6('alpha')} AS alpha, {s6('beta')} AS beta, {s6('kge')} AS kge FROM kge")
def kge(t):
    return _round(scores.kge(forecast(t), (*RUN, "node"), mean_floor=0.9), "r", "alpha", "beta", "kge")


POD = """pod_nodes AS (SELECT model, seed, horizon, node, count(*) AS n, count(*) FILTER (WHERE pred >= 1.2 AND target >= 1.2) AS tp, count(*) FILTER (WHERE pred >= 1.2 AND target < 1.2) AS fp,
  count(*) FILTER (WHERE pred < 1.2 AND target >= 1.2) AS fn, count(*) FILTER (WHERE pred < 1.2 AND target < 1.2) AS tn FROM forecast WHERE valid GROUP BY 1, 2, 3, 4),
pod AS (SELECT model, seed, horizon, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn FROM pod_nodes WHERE n >= 10 GROUP BY 1, 2, 3)"""


@query("k13_pod_far", f"WITH {FORECAST}, {POD} SELECT *, {s6('tp / (tp + fn + 1e-8)')} AS pod, {s6('fp / (tp + fp + 1e-8)')} AS far FROM pod")
def pod_far(t):
    return _round(scores.pod_far(forecast(t), RUN, F.lit(1.2)), "pod", "far")


@query(
    "k14_pod_far_unmasked",
    f"""WITH {FORECAST}, c AS (SELECT model, seed, horizon, count(*) FILTER (WHERE pred >= 1.2 AND target >= 1.2) AS tp, count(*) FILTER (WHERE pred >= 1.2 AND target < 1.2) AS fp,
  count(*) FILTER (WHERE pred < 1.2 AND target >= 1.2) AS fn, count(*) FILTER (WHERE pred < 1.2 AND target < 1.2) AS tn FROM forecast GROUP BY 1, 2, 3)
SELECT *, {s6('tp / greatest(tp + fn, 1)')} AS pod, {s6('fp / greatest(tp + fp, 1)')} AS far FROM c""",
)
def pod_far_unmasked(t):
    return _round(scores.pod_far_unmasked(forecast(t), RUN, F.lit(1.2)), "pod", "far")


@query("k16_pooled_scores", f"WITH {FORECAST} SELECT model, horizon, count(*) AS n, {s6('1 - sum((pred - target)^2) / (var_pop(target) * count(*))')} AS nse, {s6('sqrt(avg((pred - target)^2))')} AS rmse FROM forecast GROUP BY 1, 2")
def pooled_scores(t):
    return _round(scores.pooled_scores(forecast(t), ("model", "horizon")), "nse", "rmse")


@query(
    "k17_skill_by_node",
    f"""WITH {FORECAST}, {NODE_AGG}, b AS (SELECT seed, horizon, node, nse AS p FROM node_agg WHERE model = 'm_c' AND n >= 2)
SELECT model, seed, horizon, node, {s6('nse')} AS nse, {s6('p')} AS persist_nse, {s6('(nse - p) / greatest(1 - p, 1e-8)')} AS skill FROM node_agg LEFT JOIN b USING (seed, horizon, node) WHERE model <> 'm_c' AND n >= 2""",
)
def skill_by_node(t):
    per_node = scores.node_scores(forecast(t).where("valid"), (*RUN, "node")).where("n_valid >= 2")
    base = per_node.where("model = 'm_c'").select("seed", "horizon", "node", "nse")
    out = scores.skill(per_node.where("model <> 'm_c'").select(*RUN, "node", "nse"), base, ("seed", "horizon", "node"))
    return _round(out, "nse", "persist_nse", "skill").select(*RUN, "node", "nse", "persist_nse", "skill")


@query(
    "k17_skill_by_step",
    f"""WITH {FORECAST}, a AS (SELECT model, horizon, step, node, count(*) AS n, 1 - sum((pred - target)^2) / greatest(var_pop(target) * count(*), 1e-8) AS nse FROM forecast WHERE valid GROUP BY 1, 2, 3, 4),
s AS (SELECT model, horizon, step, avg(nse) AS nse FROM a WHERE n >= 2 GROUP BY 1, 2, 3), b AS (SELECT horizon, step, nse AS p FROM s WHERE model = 'm_c')
SELECT model, horizon, step, {s6('nse')} AS nse, {s6('p')} AS persist_nse, CASE WHEN p < 1 THEN {s6('(nse - p) / greatest(1 - p, 1e-8)')} END AS skill FROM s LEFT JOIN b USING (horizon, step) WHERE model <> 'm_c'""",
)
def skill_by_step(t):
    s = scores.step_scores(forecast(t), ("model", "horizon")).select("model", "horizon", "step", "nse")
    out = scores.skill(s.where("model <> 'm_c'"), s.where("model = 'm_c'"), ("horizon", "step"), null_if_perfect=True)
    return _round(out, "nse", "persist_nse", "skill").select("model", "horizon", "step", "nse", "persist_nse", "skill")


@query(
    "k18_persistence_baseline",
    f"""WITH {SLOTS}, f AS (SELECT series_id, ts, coalesce(value, 0) AS y, value IS NOT NULL AS ok, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM grid),
p AS (SELECT a.series_id, a.y AS pred, b.y AS target FROM f a JOIN f b ON a.series_id = b.series_id AND b.i BETWEEN a.i + 1 AND a.i + 4 WHERE a.i >= floor(a.n * 0.85::DOUBLE) AND a.i < a.n - 4 AND b.ok)
SELECT series_id, count(*) AS n, {s6('1 - sum((pred - target)^2) / (var_pop(target) * count(*))')} AS nse, {s6('sqrt(avg((pred - target)^2))')} AS rmse FROM p GROUP BY 1""",
)
def persistence_baseline(t):
    g = grid(t).withColumn("valid", F.col("value").isNotNull()).withColumn("value", F.coalesce("value", F.lit(0.0)))
    return _round(scores.persistence_baseline(g, 4, source=t.events), "nse", "rmse")


@query(
    "k19_to_absolute",
    f"""WITH {FORECAST}, l AS (SELECT user_id AS node, arg_max(value, event_id) / 50 AS last_obs FROM events GROUP BY 1)
SELECT f.row_id, f.model, f.node, {s6('pred - target + last_obs')} AS pred FROM forecast f JOIN l USING (node) WHERE step = 4""",
)
def to_absolute(t):
    last = t.events.groupBy(F.col("user_id").alias("node")).agg((F.max_by("value", "event_id") / 50).alias("last_obs"))
    delta = forecast(t).withColumn("pred", F.col("pred") - F.col("target"))
    return scores.to_absolute(delta, last, ("node",), 4).select("row_id", "model", "node", r6("pred").alias("pred"))


@query(
    "k20_ensemble_mean",
    f"WITH {FORECAST} SELECT model, horizon, node, date_trunc('day', ts) AS ts, {s6('avg(pred)')} AS pred, {s6('avg(target)')} AS target, count(DISTINCT seed) AS n_seeds FROM forecast GROUP BY 1, 2, 3, 4",
)
def ensemble_mean(t):
    daily = forecast(t).withColumn("ts", timegrid.slot("ts", "1 day"))
    return _round(scores.ensemble_mean(daily), "pred", "target")


@query(
    "k64_class_scores",
    f"""WITH {FORECAST}, c AS (SELECT model, horizon, count(*) FILTER (WHERE pred > 1.2 AND target > 1.2) AS tp, count(*) FILTER (WHERE pred > 1.2 AND NOT target > 1.2) AS fp,
  count(*) FILTER (WHERE NOT pred > 1.2 AND target > 1.2) AS fn, count(*) FILTER (WHERE NOT pred > 1.2 AND NOT target > 1.2) AS tn FROM forecast WHERE valid GROUP BY 1, 2)
SELECT *, {s6('tp / greatest(tp + fp + fn, 1e-8)')} AS csi, {s6('tp / greatest(tp + fn, 1e-8)')} AS pod, {s6('fp / greatest(tp + fp, 1e-8)')} AS far, {s6('2 * tp / greatest(2 * tp + fp + fn, 1e-8)')} AS f1 FROM c""",
)
def class_scores(t):
    out = scores.class_scores(forecast(t), ("model", "horizon"), F.col("pred") > 1.2, F.col("target") > 1.2, F.col("valid"))
    return _round(out, "csi", "pod", "far", "f1")


@query(
    "k67_class_weight",
    f"""WITH {FORECAST}, c AS (SELECT model, horizon, sum(CASE WHEN target > 1.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pos, count(*) AS n FROM forecast WHERE valid GROUP BY 1, 2)
SELECT *, {s6('least(greatest((n - pos) / greatest(pos, 1), 1), 100)')} AS pos_weight FROM c""",
)
def class_weight(t):
    f = forecast(t).withColumn("label", (F.col("target") > 1.2).cast("int"))
    return _round(scores.class_weight(f, ("model", "horizon"), "label", F.col("valid")), "pos_weight")
