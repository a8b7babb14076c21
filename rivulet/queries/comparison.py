"""Comparison of models over the score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import comparison, scores

from .base import FORECAST, forecast, query, r6, s6
from .scores import KGE, NODE_AGG, RUN


def _round(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


def per_node(t):
    return scores.node_scores(forecast(t).where("valid"), (*RUN, "node")).where("n_valid >= 2")


def per_run(t):
    return scores.mean_over_nodes(forecast(t), RUN)


PN = f"""WITH {FORECAST}, {NODE_AGG}, pn AS (SELECT * FROM node_agg WHERE n >= 2),
runs AS (SELECT model, seed, horizon, avg(nse) AS nse, avg(rmse) AS rmse, avg(mae) AS mae, avg(mbe) AS mbe FROM pn GROUP BY 1, 2, 3)"""
BASE = "base AS (SELECT horizon, avg(nse) AS p, avg(rmse) AS pr FROM runs WHERE model = 'm_c' AND horizon <> 12 GROUP BY 1)"


def baseline(t):
    runs = per_run(t)
    return comparison.horizon_baseline(runs.where("model = 'm_c' and horizon <> 12"), runs)


@query("k22_horizon_baseline", f"{PN}, {BASE} SELECT h.horizon, {s6('coalesce(p, 0.6813)')} AS nse, {s6('coalesce(pr, 0.0731)')} AS rmse FROM (SELECT DISTINCT horizon FROM runs) h LEFT JOIN base USING (horizon)")
def horizon_baseline(t):
    return _round(baseline(t), "nse", "rmse")


@query(
    "k21_summary_table",
    f"""{PN}, {BASE}, s AS (SELECT model, horizon, avg(nse) AS nm, stddev_samp(nse) AS ns, avg(rmse) AS rm, stddev_samp(rmse) AS rs, avg(mbe) AS mm, stddev_samp(mbe) AS ms FROM runs GROUP BY 1, 2)
SELECT model, horizon, {s6('nm')} AS nse_mean, {s6('ns')} AS nse_std, {s6('rm')} AS rmse_mean, {s6('rs')} AS rmse_std, {s6('mm')} AS mbe_mean, {s6('ms')} AS mbe_std,
  {s6('(nm - coalesce(p, 0.6813)) / (1 - coalesce(p, 0.6813))')} AS skill FROM s LEFT JOIN base USING (horizon)""",
)
def summary_table(t):
    return _round(comparison.summary_table(per_run(t), baseline(t)), "nse_mean", "nse_std", "rmse_mean", "rmse_std", "mbe_mean", "mbe_std", "skill")


PAIRS = (("m_a", "m_b"), ("m_a", "m_c"), ("m_b", "m_c"))
PAIRED = "pr AS (SELECT x.model || ' vs ' || y.model AS pair, x.horizon, x.seed, x.node, x.nse AS a, y.nse AS b FROM pn x JOIN pn y ON x.horizon = y.horizon AND x.seed = y.seed AND x.node = y.node AND x.model < y.model)"


@query(
    "j16_pairing_report",
    f"""{PN}, q AS (SELECT * FROM pn WHERE NOT (model = 'm_b' AND node < 5)), c AS (SELECT model, horizon, count(*) AS n FROM q GROUP BY 1, 2),
m AS (SELECT x.model AS ma, y.model AS mb, x.horizon, count(*) AS n FROM q x JOIN q y USING (horizon, seed, node) WHERE x.model < y.model GROUP BY 1, 2, 3)
SELECT ma || ' vs ' || mb AS pair, m.horizon, a.n AS n_a, b.n AS n_b, m.n AS n_paired, m.n < greatest(a.n, b.n) AS warn FROM m JOIN c a ON a.model = ma AND a.horizon = m.horizon JOIN c b ON b.model = mb AND b.horizon = m.horizon""",
)
def pairing_report(t):
    q = per_node(t).where("not (model = 'm_b' and node < 5)")
    return comparison.pairing_report(q, PAIRS, ("horizon",), ("node", "seed"))


@query(
    "k23_wilcoxon_statistic",
    f"""{PN}, {PAIRED}, g AS (SELECT pair, horizon, count(*) AS n_pairs, avg(a) AS ma, avg(b) AS mb FROM pr GROUP BY 1, 2),
d AS (SELECT pair, horizon, a - b AS d, rank() OVER (PARTITION BY pair, horizon ORDER BY abs(a - b)) + (count(*) OVER (PARTITION BY pair, horizon, abs(a - b)) - 1) / 2 AS r, count(*) OVER (PARTITION BY pair, horizon, abs(a - b)) AS ties FROM pr WHERE a <> b),
s AS (SELECT pair, horizon, count(*) AS n, sum(r) FILTER (WHERE d > 0) AS rp, sum(r) FILTER (WHERE d < 0) AS rm, sum(CAST(ties AS DOUBLE)^2 - 1) AS tt FROM d GROUP BY 1, 2)
SELECT pair, horizon, n_pairs, n, {s6('coalesce(rp, 0)')} AS r_plus, {s6('coalesce(rm, 0)')} AS r_minus, {s6('least(coalesce(rp, 0), coalesce(rm, 0))')} AS statistic,
  {s6('(least(coalesce(rp, 0), coalesce(rm, 0)) - n * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - tt / 48)')} AS z, {s6('abs(mb - ma)')} AS delta,
  CASE WHEN mb > ma THEN split_part(pair, ' vs ', 2) ELSE split_part(pair, ' vs ', 1) END AS winner FROM g JOIN s USING (pair, horizon) WHERE n_pairs >= 8""",
)
def wilcoxon_statistic(t):
    out = comparison.wilcoxon(per_node(t), PAIRS, ("horizon",), ("node", "seed"), with_p=False)
    return _round(out, "r_plus", "r_minus", "statistic", "z", "delta")


@query(
    "k23_wilcoxon_p",
    f"""{PN}, {PAIRED}, g AS (SELECT pair, horizon, count(*) AS n_pairs, avg(a) AS ma, avg(b) AS mb FROM pr GROUP BY 1, 2),
d AS (SELECT pair, horizon, a - b AS d, rank() OVER (PARTITION BY pair, horizon ORDER BY abs(a - b)) + (count(*) OVER (PARTITION BY pair, horizon, abs(a - b)) - 1) / 2 AS r, count(*) OVER (PARTITION BY pair, horizon, abs(a - b)) AS ties FROM pr WHERE a <> b),
s AS (SELECT pair, horizon, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS rp, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS rm, sum(CAST(ties AS DOUBLE)^2 - 1) AS tt FROM d GROUP BY 1, 2),
zs AS (SELECT pair, horizon, n, (least(rp, rm) - n * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - tt / 48) AS z, CASE WHEN mb > ma THEN split_part(pair, ' vs ', 2) ELSE split_part(pair, ' vs ', 1) END AS winner FROM g JOIN s USING (pair, horizon) WHERE n_pairs >= 8),
tail AS (SELECT pair, horizon, 2 / sqrt(pi()) * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs(z) / sqrt(2::DOUBLE) + i * 0.002::DOUBLE, 2))) * 0.002::DOUBLE / 3 AS p FROM zs, generate_series(0, 4000) t(i) GROUP BY pair, horizon, z)
SELECT pair, horizon, n, {s6('z')} AS z, {s6('p')} AS p, winner FROM zs JOIN tail USING (pair, horizon)""",
)
def wilcoxon_p(t):
    return _round(comparison.wilcoxon(per_node(t), PAIRS, ("horizon",), ("node", "seed")).select("pair", "horizon", "n", "z", "p", "winner"), "z", "p")


@query(
    "k24_node_advantage",
    f"{PN}, m AS (SELECT horizon, node, avg(nse) FILTER (WHERE model = 'm_a') AS a, avg(nse) FILTER (WHERE model = 'm_b') AS b FROM pn GROUP BY 1, 2) SELECT horizon, node, {s6('a')} AS a, {s6('b')} AS b, {s6('a - b')} AS advantage FROM m WHERE a IS NOT NULL AND b IS NOT NULL",
)
def node_advantage(t):
    return _round(comparison.node_advantage(per_node(t), "m_a", "m_b"), "a", "b", "advantage")


BEST = "m AS (SELECT horizon, node, model, avg(nse) AS s FROM pn GROUP BY 1, 2, 3), o AS (SELECT horizon, node, max(s) FILTER (WHERE model = 'm_b') AS own, max(s) FILTER (WHERE model IN ('m_a', 'm_c')) AS best FROM m GROUP BY 1, 2)"


@query("k25_advantage_over_best", f"{PN}, {BEST} SELECT horizon, node, {s6('own')} AS own, {s6('best')} AS best_baseline, {s6('own - best')} AS advantage FROM o WHERE own IS NOT NULL AND best IS NOT NULL")
def advantage_over_best(t):
    return _round(comparison.advantage_over_best(per_node(t), "m_b", ("m_a", "m_c")), "own", "best_baseline", "advantage")


@query("k25_win_loss", f"{PN}, {BEST} SELECT horizon, count(*) FILTER (WHERE own > best) AS wins, count(*) FILTER (WHERE own < best) AS losses, {s6('avg(own - best)')} AS mean_advantage FROM o WHERE own IS NOT NULL AND best IS NOT NULL GROUP BY 1")
def win_loss(t):
    return _round(comparison.win_loss(comparison.advantage_over_best(per_node(t), "m_b", ("m_a", "m_c")), ("horizon",)), "mean_advantage")


@query("k26_ablation_delta", f"{PN}, m AS (SELECT horizon, avg(nse) FILTER (WHERE model = 'm_b') AS a, avg(nse) FILTER (WHERE model = 'm_c') AS b FROM runs GROUP BY 1) SELECT horizon, {s6('a')} AS a, {s6('b')} AS b, {s6('a - b')} AS advantage FROM m")
def ablation_delta(t):
    return _round(comparison.node_advantage(per_run(t), "m_b", "m_c", ("horizon",)), "a", "b", "advantage")


@query(
    "k27_distinguishable",
    f"""{PN}, m AS (SELECT horizon, avg(nse) FILTER (WHERE model = 'm_a') AS a, avg(nse) FILTER (WHERE model = 'm_b') AS b, greatest(stddev_samp(nse) FILTER (WHERE model = 'm_a'), stddev_samp(nse) FILTER (WHERE model = 'm_b')) AS noise FROM runs GROUP BY 1)
SELECT horizon, {s6('a')} AS mean_a, {s6('b')} AS mean_b, {s6('abs(a - b)')} AS delta, {s6('noise')} AS noise, CASE WHEN abs(a - b) < noise THEN 'not distinguishable' WHEN a > b THEN 'm_a' ELSE 'm_b' END AS verdict FROM m""",
)
def distinguishable(t):
    return _round(comparison.distinguishable(per_run(t), "m_a", "m_b"), "mean_a", "mean_b", "delta", "noise")


@query(
    "k28_group_breakdown",
    f"""{PN}, g AS (SELECT DISTINCT user_id AS node, 'even' AS grp FROM events WHERE user_id % 2 = 0 UNION ALL SELECT DISTINCT user_id, 'third' FROM events WHERE user_id % 3 = 0)
SELECT grp, model, horizon, {s6('avg(nse)')} AS nse_mean, count(nse) AS n FROM pn JOIN g USING (node) GROUP BY 1, 2, 3""",
)
def group_breakdown(t):
    ids = t.events.select(F.col("user_id").alias("node")).distinct()
    groups = ids.select("node", F.explode(F.filter(F.array(F.when(F.pmod("node", F.lit(2)) == 0, "even"), F.when(F.pmod("node", F.lit(3)) == 0, "third")), lambda x: x.isNotNull())).alias("grp"))
    return _round(comparison.group_breakdown(per_node(t), groups), "nse_mean")


@query(
    "k29_step_mean_std",
    f"""WITH {FORECAST}, a AS (SELECT model, seed, horizon, step, node, count(*) AS n, 1 - sum((pred - target)^2) / greatest(var_pop(target) * count(*), 1e-8) AS nse FROM forecast WHERE valid GROUP BY ALL),
s AS (SELECT model, seed, horizon, step, avg(nse) AS nse FROM a WHERE n >= 2 GROUP BY ALL) SELECT model, horizon, step, {s6('avg(nse)')} AS nse_mean, {s6('stddev_samp(nse)')} AS nse_std FROM s GROUP BY ALL""",
)
def step_mean_std(t):
    s = scores.step_scores(forecast(t), RUN)
    return _round(comparison.seed_summary(s, ("model", "horizon", "step"), ("nse",)), "nse_mean", "nse_std")


@query("k30_seed_stability", f"{PN} SELECT model, horizon, {s6('avg(nse) FILTER (WHERE seed = 0)')} AS seed_0, {s6('avg(nse) FILTER (WHERE seed = 1)')} AS seed_1, {s6('stddev_samp(nse)')} AS nse_std FROM runs GROUP BY 1, 2")
def seed_stability(t):
    runs = per_run(t)
    out = runs.groupBy("model", "horizon").agg(*[F.avg(F.when(F.col("seed") == s, F.col("nse"))).alias(f"seed_{s}") for s in (0, 1)], F.stddev_samp("nse").alias("nse_std"))
    return _round(out, "seed_0", "seed_1", "nse_std")


@query("k31_score_matrix", f"{PN} SELECT model, {s6('avg(nse) FILTER (WHERE horizon = 4)')} AS h4, {s6('avg(nse) FILTER (WHERE horizon = 12)')} AS h12 FROM runs GROUP BY 1")
def score_matrix(t):
    return _round(comparison.matrix(per_run(t), "model", "horizon", (4, 12)), "h4", "h12")


@query(
    "k32_metric_table",
    f"""WITH {FORECAST}, {KGE}, x AS (SELECT model, horizon, unnest(['kge', 'r', 'alpha', 'beta']) AS metric, unnest([kge, r, alpha, beta]) AS value FROM kge)
SELECT model, horizon, metric, {s6('avg(value)')} AS mean, {s6('stddev_samp(value)')} AS std, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY 1, 2, 3""",
)
def metric_table(t):
    k = scores.kge(forecast(t), (*RUN, "node"), mean_floor=0.9)
    return _round(comparison.metric_table(k, ("model", "horizon"), ("kge", "r", "alpha", "beta")), "mean", "std")


@query(
    "k12_kge_summary",
    f"""WITH {FORECAST}, {KGE} SELECT model, seed, horizon, {s6('avg(kge)')} AS kge_mean, {s6('avg(r)')} AS kge_r_mean, {s6('avg(alpha)')} AS kge_alpha_mean, {s6('avg(beta)')} AS kge_beta_mean,
  {s6('avg(CASE WHEN kge IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS kge_excluded_frac FROM kge GROUP BY 1, 2, 3""",
)
def kge_summary(t):
    k = scores.kge(forecast(t), (*RUN, "node"), mean_floor=0.9)
    return _round(scores.kge_summary(k, RUN), "kge_mean", "kge_r_mean", "kge_alpha_mean", "kge_beta_mean", "kge_excluded_frac")


@query(
    "k33_curve_overlay",
    f"""WITH h AS (SELECT event_type AS model, user_id % 3 AS run, CAST(date_part('day', ts) AS INTEGER) AS epoch, avg(value) AS l FROM events GROUP BY 1, 2, 3),
b AS (SELECT *, min(l) OVER (PARTITION BY model, run) AS lo, max(l) OVER (PARTITION BY model, run) AS hi FROM h)
SELECT model, epoch, {s6('avg(CASE WHEN hi > lo THEN 1 - (l - lo) / (hi - lo) ELSE 0 END)')} AS score, count(*) AS n_runs FROM b GROUP BY 1, 2""",
)
def curve_overlay(t):
    h = t.events.groupBy(F.col("event_type").alias("model"), F.pmod("user_id", F.lit(3)).alias("run"), F.dayofmonth("ts").alias("epoch")).agg(F.avg("value").alias("val_loss"))
    curves = comparison.training_curve(h, ("model", "run"), ("val_nse",), "val_loss")
    return _round(comparison.curve_overlay(curves), "score")


@query("k66_horizon_curves", f"{PN} SELECT model, horizon, {s6('avg(nse)')} AS nse_mean, {s6('stddev_samp(nse)')} AS nse_std, {s6('avg(rmse)')} AS rmse_mean, {s6('stddev_samp(rmse)')} AS rmse_std FROM runs GROUP BY 1, 2")
def horizon_curves(t):
    return _round(comparison.seed_summary(per_run(t), ("model", "horizon"), ("nse", "rmse")), "nse_mean", "nse_std", "rmse_mean", "rmse_std")


@query(
    "a10_missing_runs",
    f"""WITH {FORECAST}, p AS (SELECT DISTINCT model, seed, horizon FROM forecast WHERE NOT (model = 'm_b' AND seed = 1))
SELECT m.model, s.seed, h.horizon FROM (VALUES ('m_a'), ('m_b'), ('m_c'), ('m_d')) m(model), (VALUES (0::BIGINT), (1), (2)) s(seed), (VALUES (4), (12), (16)) h(horizon) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.model = m.model AND p.seed = s.seed AND p.horizon = h.horizon)""",
)
def missing_runs(t):
    present = forecast(t).where("not (model = 'm_b' and seed = 1)").select(*RUN)
    return comparison.expected_runs(present, {"model": ("m_a", "m_b", "m_c", "m_d"), "seed": (0, 1, 2), "horizon": (4, 12, 16)})


@query(
    "a21_group_runs",
    f"""WITH {FORECAST}, p AS (SELECT DISTINCT model, horizon, 'runs/' || model || '/' || seed || '/' || horizon AS path FROM forecast)
SELECT model, horizon, string_agg(path, ',' ORDER BY path) AS paths, count(*) AS n_runs FROM p GROUP BY 1, 2""",
)
def group_runs(t):
    p = forecast(t).select("model", "horizon", F.concat_ws("/", F.lit("runs"), "model", "seed", "horizon").alias("path")).distinct()
    return comparison.group_runs(p).withColumn("paths", F.array_join("paths", ","))


# ----------------------------------------------------------------- scenarios
SCEN = f"""WITH {FORECAST}, f AS (SELECT f.*, e.event_type AS scenario FROM forecast f JOIN events e ON e.event_id = f.row_id),
sc AS (SELECT model, seed, horizon, scenario, 1 - sum((pred - target)^2) / (var_pop(target) * count(*)) AS nse, sqrt(avg((pred - target)^2)) AS rmse FROM f GROUP BY 1, 2, 3, 4)"""


def scenario_runs(t):
    kinds = t.events.select(F.col("event_id").alias("row_id"), F.col("event_type").alias("scenario"))
    return scores.pooled_scores(forecast(t).join(kinds, "row_id"), (*RUN, "scenario"))


@query("k34_scenario_summary", f"{SCEN} SELECT model, scenario, horizon, {s6('avg(nse)')} AS mean, {s6('stddev_samp(nse)')} AS std, count(nse) AS n FROM sc GROUP BY 1, 2, 3")
def scenario_summary(t):
    return _round(comparison.scenario_summary(scenario_runs(t)), "mean", "std")


@query(
    "k34_best_and_worst",
    f"""{SCEN}, m AS (SELECT scenario, horizon, model, avg(nse) AS s FROM sc GROUP BY 1, 2, 3)
SELECT scenario, horizon, arg_max(model, s) AS best_model, {s6('max(s)')} AS best, arg_min(model, s) AS worst_model, {s6('min(s)')} AS worst, {s6('max(s) - min(s)')} AS gap FROM m GROUP BY 1, 2""",
)
def best_and_worst(t):
    return _round(comparison.best_and_worst(scenario_runs(t)), "best", "worst", "gap")


@query(
    "k35_scenario_minus_real",
    f"""{SCEN}, r AS (SELECT model, horizon, avg(nse) AS rn FROM (SELECT model, seed, horizon, 1 - sum((pred - target)^2) / (var_pop(target) * count(*)) AS nse FROM f GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT model, horizon, scenario, avg(nse) AS sn FROM sc GROUP BY 1, 2, 3)
SELECT replace(model, '_', ' ') AS model_key, scenario, horizon * 0.25::DOUBLE AS hours, {s6('sn - rn')} AS delta FROM s JOIN r USING (model, horizon)""",
)
def scenario_minus_real(t):
    real = scores.pooled_scores(forecast(t), RUN).withColumn("model", F.concat(F.upper("model"), F.lit(" (real)")))
    out = comparison.scenario_minus_real(scenario_runs(t).withColumn("horizon", F.concat((F.col("horizon") * 15 / 60).cast("int"), F.lit(" hr"))), real)
    return _round(out, "delta")


@query(
    "k36_degradation_table",
    f"""{SCEN}, r AS (SELECT model, seed, horizon, sqrt(avg((pred - target)^2)) AS real FROM f GROUP BY 1, 2, 3), d AS (SELECT sc.*, rmse / real AS ratio FROM sc JOIN r USING (model, seed, horizon))
SELECT scenario, model, horizon, {s6('avg(ratio)')} AS ratio_mean, {s6('stddev_samp(ratio)')} AS ratio_std, {s6('avg(rmse)')} AS rmse_mean, {s6('stddev_samp(rmse)')} AS rmse_std FROM d GROUP BY 1, 2, 3""",
)
def degradation_table(t):
    real = scores.pooled_scores(forecast(t), RUN).select(*RUN, F.col("rmse").alias("real"))
    d = scenario_runs(t).join(real, list(RUN)).withColumn("ratio", F.col("rmse") / F.col("real"))
    return _round(comparison.seed_summary(d, ("scenario", "model", "horizon"), ("ratio", "rmse")), "ratio_mean", "ratio_std", "rmse_mean", "rmse_std")


# the rest of the scenario tables
REAL = "r AS (SELECT model, seed, horizon, sqrt(avg((pred - target)^2)) AS real, 1 - sum((pred - target)^2) / (var_pop(target) * count(*)) AS real_nse FROM f GROUP BY 1, 2, 3)"


@query("k36_difficulty_pairs", f"{SCEN}, {REAL} SELECT model, seed, horizon, scenario, {s6('rmse')} AS scenario_score, {s6('real')} AS real_score, rmse > real AS harder FROM sc JOIN r USING (model, seed, horizon)")
def difficulty_pairs(t):
    return _round(comparison.difficulty_pairs(scenario_runs(t), scores.pooled_scores(forecast(t), RUN)), "scenario_score", "real_score")


@query(
    "k36_horizon_curve",
    f"""{SCEN}, {REAL}, rn AS (SELECT model, horizon, avg(real_nse) AS rm FROM r GROUP BY 1, 2), s AS (SELECT scenario, model, horizon, avg(nse) AS a, stddev_samp(nse) AS b FROM sc GROUP BY 1, 2, 3)
SELECT scenario, model, horizon, {s6('a')} AS nse_mean, {s6('b')} AS nse_std, {s6('rm')} AS real_mean, {s6('a - rm')} AS minus_real, CASE WHEN model IN ('m_a', 'm_b') THEN 'graph' ELSE 'no graph' END AS model_group FROM s LEFT JOIN rn USING (model, horizon)""",
)
def horizon_curve(t):
    out = comparison.scenario_horizon_curve(scenario_runs(t), scores.pooled_scores(forecast(t), RUN), ("m_a", "m_b"))
    return _round(out, "nse_mean", "nse_std", "real_mean", "minus_real").select("scenario", "model", "horizon", "nse_mean", "nse_std", "real_mean", "minus_real", "model_group")
