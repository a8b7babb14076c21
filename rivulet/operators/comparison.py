"""Model comparison: summaries over seeds, paired tests, advantages, completeness of the run matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions import expr as X
from rivulet.plans.ranks import value_counts_below


def seed_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over seeds of each metric."""
    return df.groupBy(*keys).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def horizon_baseline(baseline: DataFrame, horizons: DataFrame, fallback_nse: float = 0.6813, fallback_rmse: float = 0.0731) -> DataFrame:
    """Mean baseline score per horizon; horizons without one take the fallback constants."""
    b = baseline.groupBy("horizon").agg(F.avg("nse").alias("_n"), F.avg("rmse").alias("_r"))
    return horizons.select("horizon").distinct().join(b, "horizon", "left").select("horizon", F.coalesce("_n", F.lit(fallback_nse)).alias("nse"), F.coalesce("_r", F.lit(fallback_rmse)).alias("rmse"))


def summary_table(runs: DataFrame, baseline: DataFrame, metrics: Sequence[str] = ("nse", "rmse", "mbe"), fallback: float = 0.6813) -> DataFrame:
    """Mean +- deviation over seeds with skill against the horizon's baseline."""
    out = seed_summary(runs, ("model", "horizon"), metrics).join(baseline.select("horizon", F.col("nse").alias("_p")), "horizon", "left")
    p = F.coalesce("_p", F.lit(fallback))
    return out.withColumn("skill", F.try_divide(F.col("nse_mean") - p, 1 - p)).drop("_p")


def paired(df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str], score: str = "nse") -> DataFrame:
    """Scores of both models of each comparison side by side; null where a model lacks the key.

    The run matrix holds one score per model and key, so one aggregate puts all
    models next to each other and the comparisons unfold from it without a join.
    """
    models = sorted({m for pair in pairs for m in pair})
    wide = df.where(F.col("model").isin(*models)).groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, F.col(score))).alias(f"_{m}") for m in models])
    sides = F.array(*[F.struct(F.lit(f"{a} vs {b}").alias("pair"), F.col(f"_{a}").alias("a"), F.col(f"_{b}").alias("b")) for a, b in pairs])
    return wide.select(*keys, F.explode(sides).alias("_p")).select(*keys, "_p.*")


def pairing_report(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str], keys: Sequence[str], score: str = "nse") -> DataFrame:
    """Per comparison: rows of each side, rows matched, and whether any were left out."""
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    out = paired(df, pairs, [*by, *keys], score).groupBy("pair", *by).agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(both).alias("n_paired"))
    return out.withColumn("warn", F.col("n_paired") < F.greatest("n_a", "n_b"))


def two_sided_normal_p(z: Column, terms: int = 60) -> Column:
    """Two-sided tail of the standard normal as an expression.

    Up to 3 it is 1 minus the power series of the error function, beyond that the continued fraction of its
    complement; both are exact to about 12 digits.
    """
    x = F.abs(z) / math.sqrt(2.0)
    steps = F.sequence(F.lit(0), F.lit(terms))
    series = F.aggregate(steps, F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")), lambda a, n: F.struct(
        (a["s"] + a["t"] / (2 * n + 1)).alias("s"), (-a["t"] * x * x / (n + 1)).alias("t")))["s"]
    near = 1 - 2 / math.sqrt(math.pi) * x * series
    down = F.reverse(F.sequence(F.lit(1), F.lit(terms)))
    fraction = F.aggregate(down, F.greatest(x, F.lit(1.0)), lambda a, n: F.greatest(x, F.lit(1.0)) + n / 2.0 / a)
    far = F.exp(-x * x) / (fraction * math.sqrt(math.pi))
    return F.when(x <= 2.2, near).otherwise(far)


def wilcoxon(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str], keys: Sequence[str], score: str = "nse", min_n: int = 8, with_p: bool = True) -> DataFrame:
    """Signed-rank test per comparison: zero differences dropped, average ranks, tie-corrected normal p.

    Ranks of |d| come from counts below each distinct |d|, so a comparison may have any number of pairs.
    """
    both = paired(df, pairs, [*by, *keys], score).where("a is not null and b is not null")
    group = ["pair", *by]
    base = both.groupBy(*group).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    d = both.withColumn("_d", F.col("a") - F.col("b")).where(F.col("_d") != 0).withColumn("_abs", F.abs("_d"))
    counts = value_counts_below(d, group, "_abs")
    signed = d.groupBy(*group, "_abs").agg(F.count_if(F.col("_d") > 0).alias("_pos"), F.count_if(F.col("_d") < 0).alias("_neg"))
    ranked = counts.join(signed, [*group, "_abs"]).withColumn("_rank", F.col("n_below") + (F.col("n_equal") + 1) / 2)
    tie = F.col("n_equal").cast("double")
    agg = ranked.groupBy(*group).agg(
        F.sum("n_equal").alias("n"), F.sum(F.col("_rank") * F.col("_pos")).alias("r_plus"), F.sum(F.col("_rank") * F.col("_neg")).alias("r_minus"), F.sum(tie**3 - tie).alias("_ties"))
    n = F.col("n").cast("double")
    stat = F.least("r_plus", "r_minus")
    z = (stat - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    out = base.where(F.col("n_pairs") >= min_n).join(agg, group, "left").select(
        *group, "n_pairs", "n", "r_plus", "r_minus", stat.alias("statistic"), z.alias("z"), F.abs(F.col("mean_b") - F.col("mean_a")).alias("delta"),
        F.when(F.col("mean_b") > F.col("mean_a"), F.element_at(F.split("pair", " vs "), 2)).otherwise(F.element_at(F.split("pair", " vs "), 1)).alias("winner"))
    return out.withColumn("p", two_sided_normal_p(F.col("z"))) if with_p else out


def node_advantage(df: DataFrame, a: str, b: str, keys: Sequence[str] = ("horizon", "node"), score: str = "nse") -> DataFrame:
    """Mean over seeds of model a minus that of model b per node; one aggregate for both models."""
    m = df.groupBy(*keys).agg(F.avg(F.when(F.col("model") == a, F.col(score))).alias("a"), F.avg(F.when(F.col("model") == b, F.col(score))).alias("b"))
    return m.where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("advantage", F.col("a") - F.col("b"))


def advantage_over_best(df: DataFrame, model: str, baselines: Sequence[str], keys: Sequence[str] = ("horizon", "node"), score: str = "nse") -> DataFrame:
    m = df.groupBy(*keys, "model").agg(F.avg(score).alias("s"))
    out = m.groupBy(*keys).agg(F.max(F.when(F.col("model") == model, F.col("s"))).alias("own"), F.max(F.when(F.col("model").isin(*baselines), F.col("s"))).alias("best_baseline"))
    return out.where(F.col("own").isNotNull() & F.col("best_baseline").isNotNull()).withColumn("advantage", F.col("own") - F.col("best_baseline"))


def win_loss(advantage: DataFrame, by: Sequence[str]) -> DataFrame:
    return advantage.groupBy(*by).agg(F.count_if(F.col("advantage") > 0).alias("wins"), F.count_if(F.col("advantage") < 0).alias("losses"), F.avg("advantage").alias("mean_advantage"))


def distinguishable(df: DataFrame, a: str, b: str, by: Sequence[str] = ("horizon",), score: str = "nse") -> DataFrame:
    """Is the difference of means larger than the larger deviation over seeds?"""
    pick = lambda m: F.when(F.col("model") == m, F.col(score))
    out = df.groupBy(*by).agg(F.avg(pick(a)).alias("mean_a"), F.avg(pick(b)).alias("mean_b"), F.stddev_samp(pick(a)).alias("_sa"), F.stddev_samp(pick(b)).alias("_sb"))
    delta, noise = F.abs(F.col("mean_a") - F.col("mean_b")), F.greatest("_sa", "_sb")
    verdict = F.when(delta < noise, "not distinguishable").when(F.col("mean_a") > F.col("mean_b"), a).otherwise(b)
    return out.select(*by, "mean_a", "mean_b", delta.alias("delta"), noise.alias("noise"), verdict.alias("verdict"))


def group_breakdown(df: DataFrame, groups: DataFrame, keys: Sequence[str] = ("model", "horizon"), score: str = "nse", node: str = "node") -> DataFrame:
    """Mean score per named node group; a node may belong to several groups."""
    return df.join(groups, node).groupBy("grp", *keys).agg(F.avg(score).alias(f"{score}_mean"), F.count(score).alias("n"))


def matrix(df: DataFrame, rows: str, column: str, values: Sequence, score: str = "nse", prefix: str = "h") -> DataFrame:
    """Rows x given column values of the mean score; values are named, so no pass collects them."""
    out = df.groupBy(rows).pivot(column, list(values)).agg(F.avg(score))
    return out.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values})


def metric_table(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and deviation of several metrics in long form: one unpivot, one aggregate."""
    long = df.select(*keys, F.expr("stack({}, {}) as (metric, value)".format(len(metrics), ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics))))
    return long.where("value is not null").groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n"))


def training_curve(history: DataFrame, run: Sequence[str], score_columns: Sequence[str], loss: str) -> DataFrame:
    """Score per epoch: the first score column the run has, else its loss turned into 0..1, higher being better."""
    have = [c for c in score_columns if c in history.columns]
    span = history.groupBy(*run).agg(F.min(loss).alias("_lo"), F.max(loss).alias("_hi"), *[F.count(c).alias(f"_n_{c}") for c in have])
    h = history.join(span, list(run))
    proxy = F.when(F.col("_hi") > F.col("_lo"), 1 - (F.col(loss) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    score, known = proxy, F.lit(False)
    for c in reversed(have):
        score = F.when(F.col(f"_n_{c}") > 0, F.col(c)).otherwise(score)
        known = known | (F.col(f"_n_{c}") > 0)
    return h.withColumn("score", score).withColumn("is_proxy", ~known).drop("_lo", "_hi", *[f"_n_{c}" for c in have])


def curve_overlay(curves: DataFrame, keys: Sequence[str] = ("model", "epoch")) -> DataFrame:
    return curves.groupBy(*keys).agg(F.avg("score").alias("score"), F.count("score").alias("n_runs"))


def expected_runs(present: DataFrame, dims: dict[str, Sequence]) -> DataFrame:
    """Missing combinations of the run matrix. The expected ones are exploded from the given lists, not joined."""
    spark = present.sparkSession
    want = spark.range(1).select()
    for name, values in dims.items():
        want = want.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    types = {f.name: f.dataType for f in present.schema}
    want = want.select(*[F.col(d).cast(types[d]).alias(d) for d in dims])
    return want.join(present.select(*dims).distinct(), list(dims), "left_anti")


def group_runs(runs: DataFrame, keys: Sequence[str] = ("model", "horizon"), path: str = "path") -> DataFrame:
    """Result paths of each model and horizon; a run matrix holds one path per seed."""
    return runs.groupBy(*keys).agg(F.sort_array(F.collect_list(path)).alias("paths"), F.count(F.lit(1)).alias("n_runs"))


# ---------------------------------------------------------------- scenarios
def scenario_summary(df: DataFrame, score: str = "nse") -> DataFrame:
    return df.groupBy("model", "scenario", "horizon").agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count(score).alias("n"))


def best_and_worst(df: DataFrame, by: Sequence[str] = ("scenario", "horizon"), score: str = "nse") -> DataFrame:
    """Best and worst model per group (alphabetical on ties) and the gap between them."""
    m = df.groupBy(*by, "model").agg(F.avg(score).alias("s"))
    best = F.min(F.struct((-F.col("s")).alias("s"), F.col("model")))
    worst = F.min(F.struct(F.col("s"), F.col("model")))
    out = m.where(F.col("s").isNotNull()).groupBy(*by).agg(best.alias("_b"), worst.alias("_w"))
    return out.select(*by, F.col("_b.model").alias("best_model"), (-F.col("_b.s")).alias("best"), F.col("_w.model").alias("worst_model"), F.col("_w.s").alias("worst"), (-F.col("_b.s") - F.col("_w.s")).alias("gap"))


def scenario_minus_real(scenarios: DataFrame, real: DataFrame, score: str = "nse") -> DataFrame:
    """Scenario score minus real-test score, matched on normalised model name and horizon in hours."""
    name, hours = X.normal_model_name(F.col("model"), dashes=True), X.horizon_hours(F.col("horizon").cast("string"))
    s = scenarios.groupBy(name.alias("model_key"), "scenario", hours.alias("hours")).agg(F.avg(score).alias("_s"))
    r = real.groupBy(name.alias("model_key"), hours.alias("hours")).agg(F.avg(score).alias("_r"))
    return s.join(r, ["model_key", "hours"]).select("model_key", "scenario", "hours", (F.col("_s") - F.col("_r")).alias("delta"))


def difficulty_pairs(scenarios: DataFrame, real: DataFrame, score: str = "rmse") -> DataFrame:
    """Error on the scenario beside the error on real data of every run; a scenario is harder where its error is larger. Runs without either are left out."""
    keys = ["model", "seed", "horizon"]
    both = scenarios.select(*keys, "scenario", F.col(score).alias("scenario_score")).join(real.select(*keys, F.col(score).alias("real_score")), keys)
    return both.dropna(subset=["scenario_score", "real_score"]).withColumn("harder", F.col("scenario_score") > F.col("real_score"))


def scenario_horizon_curve(scenarios: DataFrame, real: DataFrame, graph_models: Sequence[str], score: str = "nse") -> DataFrame:
    """Score by horizon in a scenario against real data: mean and spread over seeds, per scenario and model, with the model's group (graph or not)."""
    name = F.when(F.col("model").isin(*graph_models), "graph").otherwise("no graph")
    s = seed_summary(scenarios, ("scenario", "model", "horizon"), (score,))
    r = real.groupBy("model", "horizon").agg(F.avg(score).alias("real_mean"))
    return s.join(r, ["model", "horizon"], "left").withColumn("model_group", name).withColumn("minus_real", F.col(f"{score}_mean") - F.col("real_mean"))


def role_scores(forecast: DataFrame, roles: DataFrame, by: Sequence[str], onset: int, node: str = "node", step: str = "local_step") -> DataFrame:
    """Per run and from the onset on: error at the downstream nodes, and mean excess of the prediction at the upstream ones.

    `roles` has the node and `role`, upstream or downstream. Where nothing can travel upstream the excess should be 0: it is what a model leaks against the flow
    after a release, and what backs up behind a blockage.
    """
    gap = F.col("pred") - F.col("target")
    rows = forecast.where((F.col(step) >= onset) & gap.isNotNull()).join(roles.select(node, "role"), node)
    return rows.groupBy(*by).agg(
        F.sqrt(F.avg(F.when(F.col("role") == "downstream", gap * gap))).alias("downstream_rmse"), F.avg(F.when(F.col("role") == "upstream", gap)).alias("upstream_bias"))


def leakage_table(runs: DataFrame) -> DataFrame:
    """`role_scores` of runs by model and horizon: mean and spread over seeds."""
    return seed_summary(runs, ("model", "horizon"), ("downstream_rmse", "upstream_bias"))


def blockage_table(runs: DataFrame, reverse_models: Sequence[str]) -> DataFrame:
    """`role_scores` by model over seeds and horizons, with how much a model with a reverse path narrows the excess upstream, against the mean of those without."""
    table = seed_summary(runs, ("model",), ("downstream_rmse", "upstream_bias")).withColumn("reverse_path", F.col("model").isin(*reverse_models))
    others = table.where(~F.col("reverse_path")).agg(F.avg("upstream_bias_mean")).scalar()
    return table.withColumn("bias_minus_others", F.col("upstream_bias_mean") - others)
