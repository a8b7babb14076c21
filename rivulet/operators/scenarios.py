"""Window selection, window scores and evaluation records of stress scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators.timegrid import n_steps, step_index
from rivulet.plans.fixpoint import cut
from rivulet.plans.timechunks import STEP, over_time

T_IN, T_WINDOW = 32, 104


def window_statistics(df: DataFrame, onset: int, event_len: int | None, t_window: int = T_WINDOW, keys: Sequence[str] = ("window_id",), step: str = "local_step", value: str = "value") -> DataFrame:
    """Signal-to-noise and cleanliness of each window around an event starting at `onset`.

    The largest distance from the mean before the event follows from minimum and
    maximum, so one mergeable aggregate serves both scores.
    """
    end = onset + (event_len if event_len is not None else t_window - onset)
    s, v = F.col(step), F.col(value)
    pre, post, outside = s < onset, (s >= onset) & (s < end), s >= end
    ext = lambda cond, n: [F.min(F.when(cond, v)).alias(f"_lo_{n}"), F.max(F.when(cond, v)).alias(f"_hi_{n}")]
    agg = df.groupBy(*keys).agg(F.count(F.when(pre, v)).alias("_n"), F.avg(F.when(pre, v)).alias("_m"), F.stddev_pop(F.when(pre, v)).alias("_s"), *ext(post, "p"), *ext(outside, "o"))
    noise = F.col("_s") + 1e-6
    far = lambda n: F.greatest(F.col(f"_hi_{n}") - F.col("_m"), F.col("_m") - F.col(f"_lo_{n}"))
    enough = F.col("_n") >= 3
    snr = F.when(enough & F.col("_hi_p").isNotNull(), far("p") / noise).otherwise(0.0)
    clean = F.when(~enough, 0.5).when(F.col("_hi_o").isNull(), 1.0).otherwise(1 / (1 + far("o") / noise))
    return agg.select(*keys, snr.alias("signal_to_noise"), clean.alias("cleanliness"), F.col("_s").alias("pre_std"))


def event_score(df: DataFrame, onset: int, event_len: int | None = 30, **kw) -> DataFrame:
    """Convective, saturation and gradient scenarios: signal-to-noise x cleanliness."""
    st = window_statistics(df, onset, event_len, **kw)
    return st.withColumn("score", F.col("signal_to_noise") * F.col("cleanliness")).drop("pre_std")


def outage_score(df: DataFrame, onset: int, keys: Sequence[str] = ("window_id",), step: str = "local_step", value: str = "value") -> DataFrame:
    """Outage scenario: mean distance from the last value before the failure over the noise before it."""
    s, v = F.col(step), F.col(value)
    base = df.groupBy(*keys).agg(
        F.count(F.when(s < onset, v)).alias("_n"), F.stddev_pop(F.when(s < onset, v)).alias("_s"), F.max_by(F.when(s < onset, v), F.when(s < onset, s)).alias("_frozen"))
    post = df.where(s >= onset).join(base, list(keys)).groupBy(*keys, "_n", "_s").agg(F.avg(F.abs(v - F.col("_frozen"))).alias("_d"))
    return post.select(*keys, F.when(F.col("_n") >= 3, F.col("_d") / (F.col("_s") + 1e-6)).otherwise(0.0).alias("score"))


def release_score(release: DataFrame, inflow: DataFrame, onset: int, keys: Sequence[str] = ("window_id",), step: str = "local_step", value: str = "value") -> DataFrame:
    """Release scenario: signal-to-noise at the outlet, reduced where the inflow gauge does not stay flat."""
    sn = window_statistics(release, onset, None, keys=keys, step=step, value=value).select(*keys, "signal_to_noise")
    s, v = F.col(step), F.col(value)
    flat = inflow.groupBy(*keys).agg((F.stddev_pop(F.when(s < onset, v)) + 1e-6).alias("_a"), (F.stddev_pop(F.when(s >= onset, v)) + 1e-6).alias("_b"))
    bonus = 1 / (1 + F.greatest(F.lit(0.0), F.col("_b") / F.col("_a") - 1))
    return sn.join(flat, list(keys)).select(*keys, (F.col("signal_to_noise") * bonus).alias("score"))


def blockage_score(bridge: DataFrame, upstream: DataFrame, downstream: DataFrame, onset: int, keys: Sequence[str] = ("window_id",), **kw) -> DataFrame:
    """Blockage scenario: bridge and upstream signal, weighted by downstream activity and the bridge's cleanliness."""
    st = lambda df, n: window_statistics(df, onset, None, keys=keys, **kw).withColumnsRenamed({c: f"{n}_{c}" for c in ("signal_to_noise", "cleanliness", "pre_std")})
    out = st(bridge, "b").join(st(upstream, "u"), list(keys)).join(st(downstream, "d"), list(keys))
    score = (F.col("b_signal_to_noise") + F.col("u_signal_to_noise")) * (1 + F.col("d_pre_std")) * F.col("b_cleanliness")
    return out.select(*keys, score.alias("score"))


def best_windows(scores: DataFrame, top: int = 5, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    return scores.where("score is not null").orderBy(F.desc("score"), *keys).limit(top)


def window_candidates(df: DataFrame, bankfull: DataFrame, sat: str = "sat", rain: str = "rain", stage: str = "stage", key: str = "node", sat_min: float = 0.60, sat_max: float = 0.92, max_stage_frac: float = 0.40, t_in: int = T_IN, source: DataFrame | None = None) -> DataFrame:
    """Antecedent conditions of every possible window start: is it wet enough, calm and complete?

    Nodes are reduced to one row per time step first; the look-ahead runs over that axis only.
    """
    limit = F.greatest(F.col("bankfull"), F.lit(0.30)) * max_stage_frac
    d = df.join(bankfull.select(key, "bankfull"), key)
    nulls = sum(F.col(c).isNull().cast("int") for c in (sat, rain, stage))
    per = d.groupBy("ts").agg(
        F.count(sat).alias("n_s"), F.sum(sat).alias("s_s"), F.sum(F.col(sat) * F.col(sat)).alias("s_ss"), F.count(rain).alias("n_r"), F.sum(rain).alias("s_r"),
        F.max((F.abs(F.col(stage)) > limit).cast("int")).alias("high"), F.sum(nulls).alias("nulls"), (F.count(F.lit(1)) * 3).alias("cells"))
    def ahead(w):
        fr = w.rowsBetween(0, t_in - 1)
        return {f"w_{c}": F.sum(c).over(fr) for c in ("n_s", "s_s", "s_ss", "n_r", "s_r", "nulls", "cells")} | {"w_high": F.max("high").over(fr)}

    wide = over_time(per, (), "ts", ahead, after=(t_in - 1) * STEP)
    mean = F.try_divide(F.col("w_s_s"), F.col("w_n_s"))
    std = F.sqrt(F.greatest(F.try_divide(F.col("w_s_ss"), F.col("w_n_s")) - mean * mean, F.lit(0.0)))
    proxy = F.least(F.greatest(0.50 + F.try_divide(F.col("w_s_r"), F.col("w_n_r")) * 0.27, F.lit(0.50)), F.lit(0.99))
    wet = F.when((std > 0.01) & (mean > 0.05), mean).otherwise(proxy)
    ok = wet.between(sat_min, sat_max) & (F.coalesce("w_high", F.lit(0)) == 0) & (F.col("w_nulls") <= 0.05 * F.col("w_cells"))
    return wide.select("ts", step_index(source or df).alias("idx"), wet.alias("wetness"), F.coalesce(ok, F.lit(False)).alias("ok"))


def select_windows(candidates: DataFrame, n: Column, n_windows: int | None = None, search_from: float = 0.70, stride: int = 48, t_in: int = T_IN, t_window: int = T_WINDOW) -> DataFrame:
    """Walk along the starts: an accepted one moves on by `t_in`, a rejected one by `stride`; all accepted, or the first `n_windows`.

    Each start knows its successor, so the starts the walk visits are found by
    doubling the jump length: logarithmically many joins instead of a walk.
    """
    c = candidates.withColumn("_n", n).withColumn("_from", F.floor(F.col("_n") * search_from)).where((F.col("idx") >= F.col("_from")) & (F.col("idx") < F.col("_n") - t_window))
    jump = cut(c.select("idx", (F.col("idx") + F.when(F.col("ok"), t_in).otherwise(stride)).alias("next"), "ok", (F.col("idx") == F.col("_from")).alias("seen"), "ts"))
    for _ in range(40):
        landed = jump.where("seen").select(F.col("next").alias("idx"), F.lit(True).alias("_hit")).distinct()
        further = jump.select(F.col("idx").alias("next"), F.col("next").alias("_next2"))
        moved = cut(jump.join(landed, "idx", "left").join(further, "next", "left").select(
            "idx", F.coalesce("_next2", "next").alias("next"), "ok", (F.col("seen") | F.coalesce("_hit", F.lit(False))).alias("seen"), "ts", F.col("_next2").isNotNull().alias("_more")))
        more = not moved.where("_more").isEmpty()
        jump = moved.drop("_more")
        if not more:
            # one last landing for the jumps that now all leave the range
            found = jump.where("seen and ok").select("idx", "ts")
            return found if n_windows is None else found.orderBy("idx").limit(n_windows)
    raise RuntimeError("time axis longer than 2^40 jumps")


def high_stage_windows(df: DataFrame, bankfull: DataFrame, stage: str = "stage", key: str = "node", min_nodes: int = 3, frac: float = 0.5, test_from: float = 0.85, t_in: int = T_IN, look: int = 24, t_window: int = T_WINDOW, n_windows: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """Starts (every half input length of the test part) after whose input at least `min_nodes` exceed half bankfull."""
    top = over_time(df.select(key, "ts", stage), (key,), "ts", lambda w: {"_top": F.max(stage).over(w.rowsBetween(t_in, t_in + look - 1))}, after=(t_in + look) * STEP)
    idx, n = step_index(source or df), n_steps(source or df)
    out = top.join(bankfull.select(key, "bankfull"), key).withColumn("idx", idx).withColumn("_n", n)
    start = F.floor(F.col("_n") * test_from)
    on = out.where((F.col("idx") >= start) & (F.col("idx") < F.col("_n") - t_window) & (F.pmod(F.col("idx") - start, F.lit(t_in // 2)) == 0))
    hit = on.groupBy("idx", "ts").agg(F.count_if(F.col("_top") > frac * F.col("bankfull")).alias("n_exceeding")).where(F.col("n_exceeding") >= min_nodes)
    return hit if n_windows is None else hit.orderBy("idx").limit(n_windows)


def timing_summary(errors: DataFrame, keys: Sequence[str], value: str = "abs_error_h") -> DataFrame:
    """Mean, median and number of peak timing errors per key; the errors are written once, as several passes go over them."""
    from rivulet.plans.quantiles import exact_quantiles

    known = cut(errors.select(*keys, value).where(F.col(value).isNotNull()))
    agg = known.groupBy(*keys).agg(F.avg(value).alias("mean_h"), F.count(F.lit(1)).alias("n_events"))
    return agg.join(exact_quantiles(known, list(keys), value, {"median_h": 0.5}), list(keys))


def extended_record(kge: DataFrame, detection: DataFrame, timing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One record per run: efficiency parts, detection rates and peak timing."""
    out = kge.join(detection, list(keys), "left").join(timing.withColumnsRenamed({"mean_h": "peak_timing_mean_hr", "median_h": "peak_timing_median_hr", "n_events": "peak_timing_n_events"}), list(keys), "left")
    return out.withColumn("peak_timing_n_events", F.coalesce("peak_timing_n_events", F.lit(0)))
