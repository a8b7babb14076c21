"""Verification scores of a forecast table.

Sums of squares around a mean come from the mergeable variance aggregate, so
every score is one pass with map-side combination: no window over the facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators.timegrid import n_steps, step_index
from rivulet.plans.fixpoint import cut
from rivulet.plans.quantiles import exact_quantiles
from rivulet.plans.timechunks import STEP, over_time



def _err() -> Column:
    return F.col("pred") - F.col("target")


def _ss_res() -> Column:
    return F.sum(_err() * _err())


def _ss_tot() -> Column:
    return F.var_pop("target") * F.count("target")


def _known(df: DataFrame, valid: str | None) -> DataFrame:
    ok = F.col("pred").isNotNull() & F.col("target").isNotNull()
    return df.where(ok & F.col(valid)) if valid else df.where(ok)


def node_scores(df: DataFrame, keys: Sequence[str], valid: str | None = "valid", floor: float = 1e-8, min_rows: int = 2) -> DataFrame:
    """RMSE, MAE, NSE, mean bias and row count per key; fewer than `min_rows` valid rows give nulls and n = 0."""
    ok = F.lit(True) if valid is None else F.col(valid)
    ok = ok & F.col("pred").isNotNull() & F.col("target").isNotNull()
    p, t = F.when(ok, F.col("pred")), F.when(ok, F.col("target"))
    e = p - t
    agg = df.groupBy(*keys).agg(
        F.count(t).alias("_n"), F.sum(e * e).alias("_res"), F.avg(F.abs(e)).alias("_mae"), F.avg(e).alias("_mbe"), F.var_pop(t).alias("_var"))
    enough = F.col("_n") >= min_rows
    nse = 1 - F.col("_res") / F.greatest(F.col("_var") * F.col("_n"), F.lit(floor))
    return agg.select(
        *keys, F.when(enough, F.sqrt(F.col("_res") / F.col("_n"))).alias("rmse"), F.when(enough, F.col("_mae")).alias("mae"),
        F.when(enough, nse).alias("nse"), F.when(enough, F.col("_mbe")).alias("mbe"), F.when(enough, F.col("_n")).otherwise(0).alias("n_valid"))


def mean_over_nodes(df: DataFrame, keys: Sequence[str], node: str = "node", valid: str | None = "valid") -> DataFrame:
    """Scores per node, then their unweighted mean; nodes with fewer than two rows do not count."""
    per_node = node_scores(df, [*keys, node], valid)
    return per_node.groupBy(*keys).agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("nse").alias("nse"), F.avg("mbe").alias("mbe"))


def step_scores(df: DataFrame, keys: Sequence[str], step: str = "step", node: str = "node", valid: str | None = "valid", step_minutes: int = 15) -> DataFrame:
    out = mean_over_nodes(df, [*keys, step], node, valid)
    return out.withColumn("lead_min", F.col(step) * step_minutes)


def pooled_scores(df: DataFrame, keys: Sequence[str], valid: str | None = None, min_ss: float = 1e-12) -> DataFrame:
    """NSE and RMSE over all finite rows of a key; NSE is null where the target does not vary."""
    fin = df.where(F.col("pred").isNotNull() & F.col("target").isNotNull() & ~F.isnan("pred") & ~F.isnan("target"))
    fin = fin.where(F.col(valid)) if valid else fin
    agg = fin.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _ss_res().alias("_res"), _ss_tot().alias("_tot"))
    return agg.select(*keys, "n", F.when(F.col("_tot") > min_ss, 1 - F.col("_res") / F.col("_tot")).alias("nse"), F.sqrt(F.col("_res") / F.col("n")).alias("rmse"))


def horizon_weight(step: Column, t_out: int) -> Column:
    """Linear ramp over the horizon with mean 1."""
    return step / F.lit((t_out + 1) / 2)


def masked_mse(df: DataFrame, keys: Sequence[str], t_out: int, step: str = "step", valid: str = "valid") -> DataFrame:
    """Masked mean squared error, plain and weighted by horizon; denominators are at least 1."""
    m = F.col(valid).cast("double")
    e2 = _err() * _err()
    w = horizon_weight(F.col(step), t_out)
    return df.groupBy(*keys).agg(
        (F.sum(e2 * m) / F.greatest(F.sum(m), F.lit(1.0))).alias("mse"), (F.sum(e2 * m * w) / F.greatest(F.sum(m * w), F.lit(1.0))).alias("weighted_mse"))


def kge(df: DataFrame, keys: Sequence[str], valid: str = "valid", min_rows: int = 10, mean_floor: float = 0.05) -> DataFrame:
    """Kling-Gupta efficiency with its parts; the bias ratio is null where the observed mean is near zero."""
    d = _known(df, valid)
    agg = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("pred", "target").alias("_cov"), F.stddev_pop("pred").alias("_sp"), F.stddev_pop("target").alias("_st"),
        F.avg("pred").alias("_mp"), F.avg("target").alias("_mt"))
    enough = F.col("n") >= min_rows
    r = F.when(enough & (F.col("_sp") > 0) & (F.col("_st") > 0), F.col("_cov") / (F.col("_sp") * F.col("_st")))
    alpha = F.when(enough & (F.col("_st") > 1e-10), F.col("_sp") / F.col("_st"))
    beta = F.when(enough & (F.abs("_mt") > mean_floor), F.col("_mp") / F.col("_mt"))
    out = agg.select(*keys, "n", r.alias("r"), alpha.alias("alpha"), beta.alias("beta"))
    return out.withColumn("kge", 1 - F.sqrt((F.col("r") - 1) ** 2 + (F.col("alpha") - 1) ** 2 + (F.col("beta") - 1) ** 2))


def kge_summary(per_node: DataFrame, keys: Sequence[str]) -> DataFrame:
    return per_node.groupBy(*keys).agg(
        F.avg("kge").alias("kge_mean"), F.avg("r").alias("kge_r_mean"), F.avg("alpha").alias("kge_alpha_mean"), F.avg("beta").alias("kge_beta_mean"),
        F.avg(F.col("kge").isNull().cast("double")).alias("kge_excluded_frac"))


def _confusion(p: Column, o: Column) -> list[Column]:
    return [F.count_if(p & o).alias("tp"), F.count_if(p & ~o).alias("fp"), F.count_if(~p & o).alias("fn"), F.count_if(~p & ~o).alias("tn")]


def pod_far(df: DataFrame, keys: Sequence[str], threshold: Column, node: str = "node", valid: str = "valid", min_rows: int = 10) -> DataFrame:
    """Detection and false-alarm rates pooled over nodes with at least `min_rows` valid rows."""
    per_node = _known(df, valid).groupBy(*keys, node).agg(F.count(F.lit(1)).alias("_n"), *_confusion(F.col("pred") >= threshold, F.col("target") >= threshold))
    agg = per_node.where(F.col("_n") >= min_rows).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return agg.withColumn("pod", F.col("tp") / (F.col("tp") + F.col("fn") + F.lit(1e-8))).withColumn("far", F.col("fp") / (F.col("tp") + F.col("fp") + F.lit(1e-8)))


def pod_far_unmasked(df: DataFrame, keys: Sequence[str], threshold: Column) -> DataFrame:
    """Scenario variant: all rows count and denominators are at least 1."""
    agg = df.groupBy(*keys).agg(*_confusion(F.col("pred") >= threshold, F.col("target") >= threshold))
    return agg.withColumn("pod", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).withColumn("far", F.col("fp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)))


def class_scores(df: DataFrame, keys: Sequence[str], pred: Column, obs: Column, valid: Column) -> DataFrame:
    """CSI, POD, FAR and F1 of predicted classes on valid rows, guarded denominators."""
    agg = df.where(valid).groupBy(*keys).agg(*_confusion(pred, obs))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    safe = lambda d: F.greatest(d, F.lit(1e-8))
    return agg.withColumns({"csi": tp / safe(tp + fp + fn), "pod": tp / safe(tp + fn), "far": fp / safe(tp + fp), "f1": 2 * tp / safe(2 * tp + fp + fn)})


def class_weight(df: DataFrame, keys: Sequence[str], label: str, valid: Column, lo: float = 1.0, hi: float = 100.0) -> DataFrame:
    """Negatives per positive on valid rows, bounded."""
    agg = df.where(valid).groupBy(*keys).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count(label).alias("n"))
    return agg.withColumn("pos_weight", F.least(F.greatest((F.col("n") - F.col("pos")) / F.greatest("pos", F.lit(1.0)), F.lit(lo)), F.lit(hi)))


def skill(scores: DataFrame, baseline: DataFrame, keys: Sequence[str], null_if_perfect: bool = False) -> DataFrame:
    """(nse - baseline) / (1 - baseline); the step variant is null where the baseline is perfect."""
    out = scores.join(baseline.select(*keys, F.col("nse").alias("persist_nse")), list(keys), "left")
    room = 1 - F.col("persist_nse")
    val = (F.col("nse") - F.col("persist_nse")) / F.greatest(room, F.lit(1e-8))
    return out.withColumn("skill", F.when(F.col("persist_nse") < 1, val) if null_if_perfect else val)


def persistence_baseline(grid: DataFrame, horizon: int, keys: Sequence[str] = ("series_id",), ts: str = "ts", value: str = "value", valid: str = "valid", test_from: float = 0.85, step: int = STEP, source: DataFrame | None = None) -> DataFrame:
    """Score of 'the value stays' over the test part: y(t) against every valid y(t+1) .. y(t+horizon)."""
    pos = grid.withColumn("_idx", step_index(source or grid, ts, step)).withColumn("_n", n_steps(source or grid, ts, step))
    ahead = over_time(
        pos, keys, ts,
        lambda w: {"_next": F.collect_list(F.struct(F.col(value).alias("y"), F.col(valid).alias("ok"))).over(w.rowsBetween(1, horizon))},
        after=horizon * step,
    )
    starts = ahead.where((F.col("_idx") >= F.floor(F.col("_n") * test_from)) & (F.col("_idx") < F.col("_n") - horizon))
    pairs = starts.select(*keys, F.col(value).alias("pred"), F.explode("_next").alias("_p")).where("_p.ok")
    pairs = pairs.select(*keys, "pred", F.col("_p.y").alias("target"))
    return pooled_scores(pairs, keys, min_ss=0.0)


def to_absolute(df: DataFrame, last_obs: DataFrame, keys: Sequence[str], t_out: int) -> DataFrame:
    """Predicted change plus the last observation, at the last step of the horizon."""
    out = df.where(F.col("step") == t_out).join(last_obs.select(*keys, "last_obs"), list(keys))
    return out.withColumn("pred", F.col("pred") + F.col("last_obs"))


def ensemble_mean(df: DataFrame, keys: Sequence[str] = ("model", "horizon", "node", "ts")) -> DataFrame:
    """Mean prediction over seeds."""
    return df.groupBy(*keys).agg(F.avg("pred").alias("pred"), F.avg("target").alias("target"), F.count_distinct("seed").alias("n_seeds"))


# ------------------------------------------------------- scenario scores
def phase_scores(df: DataFrame, rules: DataFrame, keys: Sequence[str], min_rows: int = 5) -> DataFrame:
    """RMSE or bias over rows whose (scenario, node, local step) fall into a phase rule [from, to).

    `rules` holds scenario, node, metric name, kind (rmse | bias), step_from, step_to.
    """
    hit = df.join(rules, ["scenario", "node"]).where((F.col("local_step") >= F.col("step_from")) & (F.col("local_step") < F.col("step_to")))
    agg = hit.groupBy(*keys, "metric", "kind").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(_err() * _err())).alias("_rmse"), F.avg(_err()).alias("_bias"))
    val = F.when(F.col("kind") == "rmse", F.col("_rmse")).otherwise(F.col("_bias"))
    return agg.select(*keys, "metric", "n", F.when(F.col("n") >= min_rows, val).alias("value"))


def outage_scores(df: DataFrame, outages: DataFrame, real: DataFrame, keys: Sequence[str], onset: int, min_rows: int = 5) -> DataFrame:
    """RMSE after the outage began, for all nodes and for nodes failed at that very step, and ratios to the real RMSE.

    `outages` lists realization_id, node, duration_steps once per failed node.
    """
    post = df.where(F.col("local_step") >= onset).join(outages, ["realization_id", "node"], "left")
    failed = F.col("duration_steps").isNotNull() & (F.col("local_step") < onset + F.col("duration_steps"))
    e2 = _err() * _err()
    agg = post.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sqrt(F.avg(e2)).alias("_all"), F.count_if(failed).alias("n_failed"), F.sqrt(F.avg(F.when(failed, e2))).alias("_failed"))
    out = agg.join(real.select(*keys, F.col("rmse").alias("real_rmse")), list(keys), "left").select(
        *keys, F.when(F.col("_n") >= min_rows, F.col("_all")).alias("rmse_all"), "n_failed", F.when(F.col("n_failed") >= min_rows, F.col("_failed")).alias("rmse_failed"), "real_rmse")
    ratio = lambda c: F.when(F.col("real_rmse") > 0, F.col(c) / F.col("real_rmse"))
    return out.withColumn("ratio_all", ratio("rmse_all")).withColumn("ratio_failed", ratio("rmse_failed"))


def break_scores(df: DataFrame, breaks: DataFrame, keys: Sequence[str], min_rows: int = 5) -> DataFrame:
    """RMSE before and after each realization's own break step, and their ratio."""
    d = df.join(breaks, "realization_id")
    pre = F.col("local_step") < F.col("break_step")
    e2 = _err() * _err()
    agg = d.groupBy(*keys).agg(
        F.count_if(pre).alias("_np"), F.count_if(~pre).alias("_nq"), F.sqrt(F.avg(F.when(pre, e2))).alias("_p"), F.sqrt(F.avg(F.when(~pre, e2))).alias("_q"))
    out = agg.select(*keys, F.when(F.col("_np") >= min_rows, F.col("_p")).alias("rmse_pre"), F.when(F.col("_nq") >= min_rows, F.col("_q")).alias("rmse_post"))
    return out.withColumn("post_pre_ratio", F.when(F.col("rmse_pre") > 0, F.col("rmse_post") / F.col("rmse_pre")))


def realization_scores(df: DataFrame, keys: Sequence[str], min_rows: int = 5) -> DataFrame:
    out = pooled_scores(df, [*keys, "realization_id"])
    return out.where(F.col("n") >= min_rows)


def weighted_timing(per_window: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count-weighted mean of per-window mean timing errors and the middle of the per-window medians.

    The windows are written once: mean and middle would otherwise repeat their whole plan, and the driver hold its broadcasts, many times over.
    """
    per_window = cut(per_window)
    agg = per_window.groupBy(*keys).agg((F.sum(F.col("mean_h") * F.col("n_events")) / F.sum("n_events")).alias("timing_mean_h"), F.sum("n_events").alias("n_events"))
    return agg.join(exact_quantiles(per_window, list(keys), "median_h", {"timing_median_h": 0.5}), list(keys))


def scenario_record(pooled: DataFrame, detection: DataFrame, real: DataFrame, keys: Sequence[str], timing: DataFrame | None = None, timing_keys: Sequence[str] | None = None) -> DataFrame:
    """One record per run: scenario scores, detection rates, degradation against the real test, and peak timing where given.

    `timing` is the result of `weighted_timing` by `timing_keys` (all of `keys` by default); runs without a timed peak have 0 events.
    """
    out = pooled.select(*keys, F.col("nse").alias("nse_syn"), F.col("rmse").alias("rmse_syn")).join(detection.select(*keys, F.col("pod").alias("pod_syn"), F.col("far").alias("far_syn")), list(keys))
    out = out.join(real.select(*keys, F.col("rmse").alias("real_rmse")), list(keys), "left")
    out = out.withColumn("degradation_ratio", F.when(F.col("real_rmse") > 0, F.col("rmse_syn") / F.col("real_rmse")))
    if timing is None:
        return out
    on = list(timing_keys or keys)
    timing = timing.select(*on, F.col("timing_mean_h").alias("peak_timing_mean_hr"), F.col("timing_median_h").alias("peak_timing_median_hr"), F.col("n_events").alias("peak_timing_n_events"))
    return out.join(timing, on, "left").withColumn("peak_timing_n_events", F.coalesce("peak_timing_n_events", F.lit(0)))
