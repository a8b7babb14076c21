"""Regular time grids, resampling, alignment, sample windows and chronological splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.plans.fixpoint import cut
from rivulet.plans.nearest import nearest
from rivulet.plans.timechunks import DAY, HOUR, STEP, fdiv, from_micros, micros, over_time

FREQ = {"15 minutes": STEP, "1 hour": HOUR, "1 day": DAY}


def slot(ts: str, freq: str) -> Column:
    """Left edge of the slot a timestamp falls into."""
    return from_micros(fdiv(micros(ts), FREQ[freq]) * FREQ[freq])


def resample(df: DataFrame, freq: str = "15 minutes", how: str = "mean", keys: Sequence[str] = ("series_id",), ts: str = "ts", value: str = "value") -> DataFrame:
    """One value per series and non-empty slot; combines map-side, so a hot series costs one row per slot."""
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max}[how](value)
    return df.groupBy(*keys, slot(ts, freq).alias("ts")).agg(agg.alias("value"))


def slot_axis(keys: DataFrame, lo: Column, hi: Column, freq: str) -> DataFrame:
    """Every slot in [lo, hi] (epoch microseconds) for every row of `keys`, day by day."""
    size = FREQ[freq]
    days = keys.withColumn("_hi", hi).withColumn("_day", F.explode(F.sequence(lo, F.col("_hi"), F.lit(max(DAY, size)))))
    last = F.least(F.col("_day") + max(DAY, size) - size, F.col("_hi"))
    return days.withColumn("_us", F.explode(F.sequence(F.col("_day"), last, F.lit(size)))).withColumn("ts", from_micros(F.col("_us"))).drop("_day", "_hi", "_us")


def complete(slots: DataFrame, freq: str, keys: Sequence[str]) -> DataFrame:
    """Reindex slot values to every slot of the period that the slots of all series cover.

    Keys and bounds come from the slots, which are written once, so the raw rows are read once.
    """
    slots = cut(slots)
    bound = lambda agg: slots.agg(micros(agg("ts"))).scalar()
    axis = slot_axis(slots.select(*keys).distinct(), bound(F.min), bound(F.max), freq)
    return axis.join(slots, [*keys, "ts"], "left")


def regular_grid(df: DataFrame, freq: str = "15 minutes", how: str = "mean", keys: Sequence[str] = ("series_id",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Every series at every slot of the common period; slots without readings are null."""
    return complete(resample(df, freq, how, keys, ts, value), freq, keys)


def resample_own_span(df: DataFrame, freq: str, keys: Sequence[str] = ("series_id",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Sums per slot with empty slots inside a series' own first..last reading set to 0."""
    size = FREQ[freq]
    span = df.groupBy(*keys).agg((fdiv(micros(F.min(ts)), size) * size).alias("_lo"), (fdiv(micros(F.max(ts)), size) * size).alias("_top"))
    axis = slot_axis(span, F.col("_lo"), F.col("_top"), freq).drop("_lo", "_top")
    return axis.join(resample(df, freq, "sum", keys, ts, value), [*keys, "ts"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def clip_period(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows of the closed period; written as plain comparisons so the scan can prune."""
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) <= F.lit(end).cast("timestamp_ntz")))


def align_nearest(targets: DataFrame, sources: DataFrame, tolerance: int, keys: Sequence[str] = (), ts: str = "ts", value: str = "value") -> DataFrame:
    """Value of the source row nearest in time, at most `tolerance` away; ties go to the later one."""
    both = targets.select(*keys, ts, F.lit(True).alias("_target"), F.lit(None).cast("double").alias("_v")).unionByName(
        sources.where(F.col(value).isNotNull()).select(*keys, ts, F.lit(False).alias("_target"), F.col(value).cast("double").alias("_v"))
    )
    src = lambda: F.when(~F.col("_target"), F.struct(F.col("_us").alias("at"), F.col("_v").alias("v")))
    wide = over_time(
        both, keys, ts,
        lambda w: {
            "_back": F.last(src(), ignorenulls=True).over(w.rangeBetween(-tolerance, 0)),
            "_next": F.first(src(), ignorenulls=True).over(w.rangeBetween(0, tolerance)),
        },
        before=tolerance, after=tolerance,
    )
    us = micros(ts)
    take_next = F.col("_back").isNull() | (F.col("_next.at") - us <= us - F.col("_back.at"))
    pick = F.when(F.col("_next").isNotNull() & take_next, F.col("_next.v")).otherwise(F.col("_back.v"))
    return wide.where("_target").select(*keys, ts, pick.alias(value))


def nearest_step(events: DataFrame, steps: DataFrame, ts: str = "ts", step_ts: str = "step_ts", warn_hours: float = 6.0) -> DataFrame:
    """Nearest available time step of each event, its lag in hours and a warning flag; ties go to the earlier step."""
    pts = events.withColumn("_x", micros(ts).cast("double"))
    refs = steps.select(step_ts).distinct().withColumn("_y", micros(step_ts).cast("double"))
    hit = nearest(pts, refs, ["_x"], ["_y"], step_ts, step_ts, F.abs(F.col("_x") - F.col("_y")))
    return hit.withColumn("lag_hours", F.col("dist") / HOUR).withColumn("warn", F.col("lag_hours") > warn_hours).drop("_x", "dist")


def monthly_completeness(grid: DataFrame, keys: Sequence[str] = ("series_id",), ts: str = "ts", value: str = "value") -> DataFrame:
    return grid.groupBy(*keys, F.date_format(ts, "yyyy-MM").alias("month")).agg((F.avg(F.col(value).isNotNull().cast("double")) * 100).alias("completeness_pct"))


def sample_windows(grid: DataFrame, t_in: int, t_out: int, keys: Sequence[str] = ("series_id",), ts: str = "ts", step: int = STEP, x: str = "value") -> DataFrame:
    """Input history and target horizon of every position that has both in full.

    The target is the next-step value, so the horizon of a window ending at t covers t+1 .. t+t_out.
    """
    reach_back, reach_on = (t_in - 1) * step, t_out * step
    wide = over_time(
        grid, keys, ts,
        lambda w: {
            "inputs": F.collect_list(F.struct(F.col("_us").alias("at"), F.col(x).alias("v"))).over(w.rowsBetween(-(t_in - 1), 0)),
            "targets": F.collect_list(F.struct(F.col("_us").alias("at"), F.col(x).alias("v"))).over(w.rowsBetween(1, t_out)),
        },
        before=reach_back, after=reach_on,
    )
    full = (F.size("inputs") == t_in) & (F.size("targets") == t_out)
    return wide.where(full).select(*keys, ts, F.col("inputs.v").alias("inputs"), F.col("targets.v").alias("targets"))


def step_index(source: DataFrame, ts: str = "ts", step: int = STEP) -> Column:
    """Position of a row on the common regular axis, by arithmetic instead of a global rank.

    `source` is anything with the same period; raw readings are cheapest, as only their time column is scanned.
    """
    return ((micros(ts) - source.agg(fdiv(micros(F.min(ts)), step) * step).scalar()) / step).cast("long")


def n_steps(source: DataFrame, ts: str = "ts", step: int = STEP) -> Column:
    return source.agg(fdiv(micros(F.max(ts)), step) - fdiv(micros(F.min(ts)), step) + 1).scalar()


def split_by_windows(grid: DataFrame, t_in: int, t_out: int, train: float = 0.70, val: float = 0.15, source: DataFrame | None = None) -> DataFrame:
    """Chronological split of window starts; a gap of one full window is dropped before val and test."""
    out = grid.withColumn("idx", step_index(source or grid)).withColumn("_n", n_steps(source or grid) - t_in - t_out + 1)
    gap = t_in + t_out
    n_train, n_val = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    part = (
        F.when(F.col("idx") < n_train, "train")
        .when((F.col("idx") >= n_train + gap) & (F.col("idx") < n_train + gap + n_val), "val")
        .when((F.col("idx") >= n_train + 2 * gap + n_val) & (F.col("idx") < F.col("_n")), "test")
    )
    return out.withColumn("split", part).where(F.col("split").isNotNull()).drop("_n")


def split_by_time(grid: DataFrame, t_in: int, t_out: int, train: float = 0.70, val: float = 0.15, source: DataFrame | None = None) -> DataFrame:
    """Chronological split by time boundary; `idx` is a window start whose last target must fit its part."""
    out = grid.withColumn("idx", step_index(source or grid)).withColumn("_n", n_steps(source or grid))
    span, purge = t_in + t_out, t_in + t_out - 1
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * (train + val))
    part = (
        F.when(F.col("idx") <= a - span, "train")
        .when((F.col("idx") >= a + purge) & (F.col("idx") <= b - span), "val")
        .when((F.col("idx") >= b + purge) & (F.col("idx") <= F.col("_n") - span), "test")
    )
    return out.withColumn("split", part).where(F.col("split").isNotNull()).drop("_n")


def train_slice(grid: DataFrame, frac: float = 0.70, source: DataFrame | None = None) -> DataFrame:
    """Only the leading share of the time axis."""
    out = grid.withColumn("idx", step_index(source or grid)).withColumn("_n", n_steps(source or grid))
    return out.where(F.col("idx") < F.floor(F.col("_n") * frac)).drop("_n")


def window_position(idx: Column, t_window: int, t_in: int, t_out: int) -> dict[str, Column]:
    """Window number and step inside it for forecast rows over back-to-back windows.

    Row 0 is the last target step of the first sample, t_in + t_out - 1 steps into the first window.
    """
    at = idx + (t_in + t_out - 1)
    return {"window_id": F.floor(at / t_window).cast("long"), "local_step": F.pmod(at, F.lit(t_window)).cast("long")}
