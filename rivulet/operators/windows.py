"""Frames over gauge series: features, targets, events, climatology, profiles, scores of windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rivulet.functions import expr as X
from rivulet.functions.expr import clip
from rivulet.plans.fixpoint import cut
from rivulet.plans.intervals import interval_join
from rivulet.plans.nearest import nearest
from rivulet.plans.quantiles import exact_quantiles
from rivulet.plans.ranks import value_counts_below
from rivulet.plans.runs import find_runs
from rivulet.plans.timechunks import DAY, HOUR, STEP, from_micros, micros, over_time

SERIES = ("series_id",)


# --------------------------------------------------------------- features
def _trailing(value: str, whole: WindowSpec, gone: WindowSpec) -> tuple[Column, Column]:
    """Sum and count of a trailing frame as the difference of two growing frames.

    A sliding frame is evaluated anew for every row (672 values for seven days of quarter hours);
    growing frames only ever add a row, so the cost no longer depends on the frame's length.
    """
    total = F.sum(value).over(whole) - F.coalesce(F.sum(value).over(gone), F.lit(0.0))
    return total, F.count(value).over(whole) - F.count(value).over(gone)


def _trailing_mean(w: WindowSpec, value: str, reach: int, shift: int = 0) -> Column:
    """Mean over (t + shift - reach, t + shift], nulls skipped."""
    first = Window.unboundedPreceding
    total, n = _trailing(value, w.rangeBetween(first, shift), w.rangeBetween(first, shift - reach))
    return F.when(n > 0, total / n)


def stage_anomaly(grid: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value", days: int = 7) -> DataFrame:
    """Value minus its trailing mean over (t - days, t], nulls skipped."""
    reach = days * DAY
    return over_time(grid, keys, ts, lambda w: {"stage_anomaly": F.col(value) - _trailing_mean(w, value, reach)}, before=reach)


def rate_of_change(grid: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value", per_hour: int = 4) -> DataFrame:
    """Difference to the previous step in units per hour; null differences become 0."""
    return over_time(grid, keys, ts, lambda w: {"dh_dt": F.coalesce((F.col(value) - F.lag(value).over(w)) * per_hour, F.lit(0.0))}, before=STEP)


def next_step_target(df: DataFrame, feature: str, horizon: int = 1, keys: Sequence[str] = SERIES, ts: str = "ts", step: int = STEP) -> DataFrame:
    """Value `horizon` steps ahead; null at the end of the record."""
    return over_time(df, keys, ts, lambda w: {"target": F.lead(feature, horizon).over(w)}, after=horizon * step)


def forward_fill(df: DataFrame, value: str, limit: int = 6, keys: Sequence[str] = SERIES, ts: str = "ts", step: int = STEP, rest: float | None = 0.0) -> DataFrame:
    """Carry the last value over at most `limit` empty steps, then put `rest`."""
    def cols(w):
        filled = F.last(value, ignorenulls=True).over(w.rowsBetween(-limit, 0))
        return {"filled": filled if rest is None else F.coalesce(filled, F.lit(rest))}

    return over_time(df, keys, ts, cols, before=limit * step)


def gauge_features(grid: DataFrame, keys: Sequence[str] = SERIES, days: int = 7, horizon: int = 1) -> DataFrame:
    """Five gauge features and the next-step target from one pass over (series, time slice).

    Needs `level`, `discharge`, `rain`, `datum` and `p90`; the anomaly, the rate
    and the target share one window partitioning, so the grid is shuffled once.
    """
    reach = days * DAY
    anomaly = lambda w: F.col("level") - _trailing_mean(w, "level", reach)
    # the target is the anomaly one step ahead: its trailing mean is the same frame moved by that step
    ahead = horizon * STEP
    target = lambda w: F.lead("level", horizon).over(w) - _trailing_mean(w, "level", reach, ahead)
    wide = over_time(
        grid, keys, "ts",
        lambda w: {
            "stage_anomaly": anomaly(w),
            "dh_dt": F.coalesce((F.col("level") - F.lag("level").over(w)) * 4, F.lit(0.0)),
            "target": target(w),
        },
        before=reach, after=ahead,
    )
    return wide.select(
        *keys, "ts", "stage_anomaly",
        X.normalised_position(F.col("level"), F.col("datum"), F.col("p90")).alias("normalized_stage"),
        "dh_dt",
        X.signed_log1p(F.coalesce("discharge", F.lit(0.0))).alias("discharge_m3s"),
        F.greatest(F.coalesce("rain", F.lit(0.0)), F.lit(0.0)).alias("rainfall_mm"),
        "target",
        F.col("level").isNotNull().alias("valid"),
    )


def rolling_sum(grid: DataFrame, rows: int, step: int, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value") -> DataFrame:
    """Sum of the last `rows` steps; null where none of them has a value."""
    def cols(w):
        first = Window.unboundedPreceding
        total, n = _trailing(value, w.rowsBetween(first, 0), w.rowsBetween(first, -rows))
        return {"rolling": F.when(n > 0, total)}

    return over_time(grid, keys, ts, cols, before=rows * step)


def horizon_label(df: DataFrame, horizon: int, threshold: Column, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value", valid: str = "valid", step: int = STEP) -> DataFrame:
    """1 where any of the next `horizon` values exceeds the threshold; valid where any of them is valid."""
    return over_time(
        df, keys, ts,
        lambda w: {
            "label": (F.max(value).over(w.rowsBetween(0, horizon - 1)) > threshold).cast("int"),
            "node_valid": F.coalesce(F.max(F.col(valid).cast("int")).over(w.rowsBetween(0, horizon - 1)) == 1, F.lit(False)),
        },
        after=(horizon - 1) * step,
    )


# ----------------------------------------------------------------- events
def threshold_events(grid: DataFrame, threshold: Column, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value", step: int = STEP, keep_open: bool = False, min_hours: float = 0.0) -> DataFrame:
    """Maximal stretches above the threshold: start, end (first step not above), duration, peak, excess.

    An event still open at the end of the record is dropped unless `keep_open`.
    """
    above = grid.withColumn("_thr", threshold).where(F.col(value) > F.col("_thr"))
    runs = find_runs(
        above, keys, ts, step,
        {"_peak": ("max", F.struct(F.col(value).alias("v"), (-micros(ts)).alias("neg"))), "threshold": ("max", F.col("_thr"))},
    )
    end_us = micros("run_end") + step
    out = runs.select(
        *keys, F.col("run_start").alias("start"), from_micros(end_us).alias("end"),
        (F.col("n_rows") * (step / HOUR)).alias("duration_h"), F.col("_peak.v").alias("peak"),
        from_micros(-F.col("_peak.neg")).alias("peak_ts"), (F.col("_peak.v") - F.col("threshold")).alias("excess"),
    ).where(F.col("duration_h") >= min_hours)
    if not keep_open:
        if keys:
            ends = grid.groupBy(*keys).agg(F.max(ts).alias("_last"))
            out = out.join(ends, list(keys)).where(F.col("end") <= F.col("_last")).drop("_last")
        else:
            out = out.where(F.col("end") <= grid.agg(F.max(ts)).scalar())
    return out


def area_maximum(grid: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Highest value over all series per time step."""
    return grid.groupBy(ts).agg(F.max(value).alias(value))


def area_events(grid: DataFrame, threshold: float = 0.3, min_hours: float = 6.0, ts: str = "ts", value: str = "value") -> DataFrame:
    """Stretches in which at least one series is above the threshold; open events are kept."""
    return threshold_events(area_maximum(grid, ts, value), F.lit(threshold), (), ts, value, keep_open=True, min_hours=min_hours)


def fallback_event(grid: DataFrame, half_steps: int = 48, ts: str = "ts", value: str = "value") -> DataFrame:
    """The stretch of `half_steps` around the overall maximum, clipped to the record."""
    top = grid.where(F.col(value).isNotNull()).agg(
        F.max(F.struct(F.col(value).alias("v"), (-micros(ts)).alias("neg"))).alias("m"))
    span = grid.agg(micros(F.min(ts)).alias("lo"), micros(F.max(ts)).alias("hi"))
    at, half = -F.col("m.neg"), half_steps * STEP
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    return top.where(F.col("m").isNotNull()).select(
        from_micros(F.greatest(lo, at - half)).alias("start"), from_micros(F.least(hi + STEP, at + half)).alias("end"),
        F.col("m.v").alias("peak"), from_micros(at).alias("peak_ts"),
    )


def most_severe_event(grid: DataFrame, threshold: float, min_hours: float = 6.0) -> DataFrame:
    """Event with the highest peak (earliest on a tie), else the stretch around the overall maximum."""
    cols = ["start", "end", "peak", "peak_ts"]
    found = area_events(grid, threshold, min_hours).select(*cols, F.lit(0).alias("rung"))
    both = found.unionByName(fallback_event(grid).select(*cols, F.lit(1).alias("rung")))
    order = F.struct(-F.col("rung"), F.col("peak"), -micros("start"))
    best = both.agg(F.max_by(F.struct(*cols), order).alias("e"))
    return best.select("e.*")


def event_ladder(grid: DataFrame, rungs: Sequence[tuple[float, float]] = ((0.3, 6.0), (0.1, 3.0)), top: int = 3) -> DataFrame:
    """Events of the first (threshold, hours) rung that has any, else the stretch around the maximum; `top` highest."""
    cols = ["start", "end", "peak", "peak_ts"]
    parts = [area_events(grid, thr, hrs).select(*cols, F.lit(i).alias("rung")) for i, (thr, hrs) in enumerate(rungs)]
    parts.append(fallback_event(grid).select(*cols, F.lit(len(rungs)).alias("rung")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    lowest = both.agg(F.min("rung")).scalar()
    return both.where(F.col("rung") == lowest).orderBy(F.desc("peak"), "start").limit(top)


def cluster_events(df: DataFrame, max_gap: int, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value") -> DataFrame:
    """Rows closer than `max_gap` belong to one event."""
    return find_runs(df, keys, ts, max_gap, {"total": ("sum", F.col(value)), "peak": ("max", F.col(value))})


# ------------------------------------------------------------------ peaks
def local_maxima(grid: DataFrame, min_height: Column | None = None, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value", step: int = STEP, with_flat: bool = False) -> DataFrame:
    """Steps strictly above both neighbours (a flat top counts at its middle) and at least `min_height`.

    Equal neighbouring values form one run; the run is a maximum if the steps on both sides are lower. A missing step,
    null or absent, is lower than any value; the first and the last step of a record are no maxima. `with_flat` adds
    the first and last step of the run.
    """
    nothing = F.lit(float("-inf"))
    us = micros(ts)
    ends = grid.groupBy(*keys).agg(F.min(us).alias("_first"), F.max(us).alias("_last"))
    shaped = over_time(
        grid.withColumn(value, F.coalesce(F.col(value).cast("double"), nothing)), keys, ts,
        lambda w: {"_prev": F.lag(value).over(w), "_next": F.lead(value).over(w), "_pus": F.lag("_us").over(w), "_nus": F.lead("_us").over(w)},
        before=step, after=step,
    )
    left = F.when(us - F.col("_pus") == step, F.col("_prev")).otherwise(nothing)
    right = F.when(F.col("_nus") - us == step, F.col("_next")).otherwise(nothing)
    v = F.col(value)
    high = v > nothing if min_height is None else (v > nothing) & (v >= min_height)
    tops = shaped.where(high & (v >= left) & (v >= right)).join(ends, list(keys)).where((us > F.col("_first")) & (us < F.col("_last")))
    flat = find_runs(
        tops.withColumn("_rise", (v > left).cast("int")).withColumn("_fall", (v > right).cast("int")),
        [*keys, value], ts, step, {"rise": ("max", F.col("_rise")), "fall": ("max", F.col("_fall"))},
    )
    mid = F.floor((micros("run_start") + micros("run_end")) / (2 * step)) * step
    flat = flat.where((F.col("rise") == 1) & (F.col("fall") == 1))
    return flat.select(*keys, from_micros(mid.cast("long")).alias(ts), value, *([F.col("run_start").alias("flat_from"), F.col("run_end").alias("flat_to")] if with_flat else []))


def thin_peaks(peaks: DataFrame, separation: int, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value") -> DataFrame:
    """Keep the highest peaks that are at least `separation` apart; of equal ones the later goes first.

    Going through the peaks from the highest down is the same as repeating one
    local rule: a peak above everything within reach is kept and removes what it
    reaches. Each round is two bounded windows, so no chain of peaks is ever
    gathered in one task; the number of rounds is the length of the longest
    rising chain, not the number of peaks.
    """
    cols = [*keys, ts, value]
    todo, kept = cut(peaks.select(*cols)), None
    near = separation - 1
    while True:  # every round settles at least the highest peak that is left
        best = lambda w: {"_best": F.max(F.struct(F.col(value), F.col("_us"))).over(w.rangeBetween(-near, near))}
        ruled = over_time(todo, keys, ts, best, before=near, after=near).withColumn("_win", (F.col("_best._us") == micros(ts)).cast("int")).drop("_best")
        ruled = cut(over_time(ruled, keys, ts, lambda w: {"_settled": F.max("_win").over(w.rangeBetween(-near, near))}, before=near, after=near))
        won = ruled.where(F.col("_win") == 1).select(*cols)
        kept = won if kept is None else kept.unionByName(won)
        todo = ruled.where(F.col("_settled") == 0).select(*cols)
        if todo.isEmpty():
            return kept


def peak_timing_error(pred: DataFrame, obs_peaks: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value", reach: int = 48 * HOUR, separation: int = 4 * HOUR, step: int = STEP) -> DataFrame:
    """Hours between each observed peak and the predicted peak nearest to it, the earlier of two equally near.

    `pred` is the predicted series on the regular grid, null where invalid. Predicted peaks are those of the window of `reach` to both
    sides (the end excluded), thinned inside it; a window without a peak counts its highest step, the first of equal ones, and
    a window without a prediction drops the observed peak. A window is a bounded number of steps, so its
    rows may meet in one task.
    """
    at, here = micros(ts), F.col("_obs")
    obs = cut(obs_peaks.select(*keys, at.alias("_obs"), F.col(value).alias("obs_peak")))
    spans = obs.select(*keys, "_obs", from_micros(here - reach).alias("_from"), from_micros(here + reach - step).alias("_to"))
    tops = local_maxima(pred, None, keys, ts, value, step, with_flat=True)
    inside = interval_join(tops, spans, ts, "_from", "_to", on=keys).where((F.col("flat_from") > F.col("_from")) & (F.col("flat_to") < F.col("_to")))
    found = thin_peaks(inside.select(*keys, "_obs", ts, value), separation, [*keys, "_obs"], ts, value)
    gap = at - here
    nearest_peak = cut(found.groupBy(*keys, "_obs").agg(F.min(F.struct(F.abs(gap).alias("d"), gap.alias("g")))["g"].alias("_gap")))
    bare = spans.join(nearest_peak, [*keys, "_obs"], "left_anti")
    rows = interval_join(pred.where(F.col(value).isNotNull()).select(*keys, ts, value), bare, ts, "_from", "_to", on=keys)
    highest = rows.groupBy(*keys, "_obs").agg(F.max(F.struct(F.col(value), -gap))["col2"].alias("_back")).select(*keys, "_obs", (-F.col("_back")).alias("_gap"))
    out = obs.join(nearest_peak.unionByName(highest), [*keys, "_obs"])
    error = F.col("_gap") / HOUR
    return out.select(*keys, from_micros(here).alias("obs_ts"), "obs_peak", error.alias("error_h"), F.abs(error).alias("abs_error_h"))


# ---------------------------------------------------- seasonal and curves
def seasonal_anomaly(grid: DataFrame, unit: str, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean per month (or hour of day) minus the mean of those means, per series."""
    part = {"month": F.month, "hour": F.hour}[unit](ts)
    by = grid.groupBy(*keys, part.alias(unit)).agg(F.avg(value).alias("mean"))
    return by.withColumn("anomaly", F.col("mean") - F.avg("mean").over(Window.partitionBy(*keys)))


def monthly_rain(grid: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean hourly rain per month scaled to a month of 30 days."""
    return grid.groupBy(*keys, F.month(ts).alias("month")).agg((F.avg(value) * 24 * 30).alias("rain_mm"))


def exceedance_curve(df: DataFrame, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Descending rank over n in percent, one row per distinct value with its first and last rank."""
    c = value_counts_below(df, keys, value)
    last = F.col("n_total") - F.col("n_below")
    return c.select(*keys, value, "n_equal", (last - F.col("n_equal") + 1).alias("first_rank"), last.alias("last_rank"), (last / F.col("n_total") * 100).alias("exceedance_pct"))


def climatology_anomaly(df: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value", window: int = 15) -> DataFrame:
    """Value minus its day-of-year mean smoothed over `window` positions around the year.

    The climatology has at most 366 rows per key, so its positions wrap by copying
    the ends; days missing in it take the circularly nearest day.
    """
    half = window // 2
    doy = df.groupBy(*keys, F.dayofyear(ts).alias("doy")).agg(F.avg(value).alias("_m"))
    doy = doy.where(F.col("_m").isNotNull())
    w = Window.partitionBy(*keys)
    pos = doy.withColumn("_pos", F.row_number().over(w.orderBy("doy"))).withColumn("_n", F.count(F.lit(1)).over(w))
    wrapped = pos.withColumn(
        "_at", F.explode(F.array_distinct(F.array(
            F.col("_pos"),
            F.when(F.col("_pos") <= half, F.col("_pos") + F.col("_n")).otherwise(F.col("_pos")),
            F.when(F.col("_pos") > F.col("_n") - half, F.col("_pos") - F.col("_n")).otherwise(F.col("_pos"))))))
    frame = Window.partitionBy(*keys).orderBy("_at").rowsBetween(-half, half)
    smooth = wrapped.withColumn("climatology", F.avg("_m").over(frame)).where(F.col("_at") == F.col("_pos")).select(*keys, "doy", "climatology")
    # every day of the year takes its own entry or the circularly nearest one, the earlier day on a tie
    away = F.abs(F.col("doy") - F.col("_of"))
    table = smooth.withColumn("_of", F.explode(F.sequence(F.lit(1), F.lit(366))))
    table = table.groupBy(*keys, F.col("_of")).agg(F.min_by("climatology", F.struct(F.least(away, 366 - away), "doy")).alias("climatology"))
    return df.withColumn("doy", F.dayofyear(ts)).join(table.withColumnRenamed("_of", "doy"), [*keys, "doy"], "left").withColumn("anomaly", F.col(value) - F.col("climatology"))


# ------------------------------------------------------ response rates (E11)
def response_rates(rain: DataFrame, stage: DataFrame, params: DataFrame, wet: float = 1.5, min_total: float = 10.0, min_rates: int = 1, min_wet: int = 3, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value", gap_steps: int = 8) -> DataFrame:
    """Median stage rise per unit of rain over the rain events of each series; null where too few events.

    `params` gives `tc_steps` per series. Event rain is summed over tc steps from
    the start, the peak is taken in steps tc .. 3 tc, the baseline over the 4 steps before.
    """
    wet_rows = rain.where(F.col(value) > wet)
    ev = cluster_events(wet_rows, gap_steps * STEP, keys, ts, value).select(*keys, F.col("run_start").alias("t0")).join(params, list(keys))
    at = micros("t0")
    tc = F.col("tc_steps").cast("long") * STEP
    wide = ev.withColumn("_from", from_micros(at - 4 * STEP)).withColumn("_to", from_micros(at + 3 * tc))
    rain_hit = interval_join(rain.select(*keys, ts, F.col(value).alias("_rain")), ev.withColumn("_rto", from_micros(at + tc)), ts, "t0", "_rto", on=keys, closed=False)
    totals = rain_hit.groupBy(*keys, "t0").agg(F.sum("_rain").alias("total"))
    hit = interval_join(stage.select(*keys, ts, F.col(value).alias("_stage")), wide, ts, "_from", "_to", on=keys, closed=False)
    rel = micros(ts) - at
    peaks = hit.groupBy(*keys, "t0").agg(
        F.avg(F.when(rel < 0, F.col("_stage"))).alias("baseline"), F.max(F.when(rel >= tc, F.col("_stage"))).alias("peak"))
    rates = totals.join(peaks, [*keys, "t0"]).where(F.col("total") >= min_total)
    rates = rates.withColumn("rate", (F.col("peak") - F.col("baseline")) / F.col("total")).where(F.col("rate") > 0)
    med = exact_quantiles(rates, keys, "rate", {"_med": 0.5})
    n = rates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rates"))
    wet_n = wet_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_wet"))
    out = params.select(*keys).join(n, list(keys), "left").join(med, list(keys), "left").join(wet_n, list(keys), "left")
    return out.withColumn("n_rates", F.coalesce("n_rates", F.lit(0))).withColumn(
        "peak_rate", F.when((F.col("n_rates") >= min_rates) & (F.col("_wet") >= min_wet), F.col("_med"))).drop("_med", "_wet")


def inherit_rates(rates: DataFrame, floor_inherit: float = 0.001, cap_inherit: float = 0.05) -> DataFrame:
    """Fill missing rates from the calibrated node with the nearest index, scaled by sqrt of the area ratio.

    Needs `node`, `area_km2`, `is_tidal`, `is_reservoir`, `peak_rate`. Fixed rates: tidal 0.003,
    reservoir 0.005, last resort 0.005; floors 0.015 / 0.010 / 0.005 by area, cap 0.030.
    """
    fixed = F.when(F.col("is_tidal"), 0.003).when(F.col("is_reservoir"), 0.005)
    base = rates.withColumn("_rate", F.coalesce(fixed, F.col("peak_rate"))).withColumn("_x", F.col("node").cast("double"))
    donors = base.where(F.col("_rate").isNotNull()).select(F.col("node").alias("donor"), F.col("_x").alias("_y"), F.col("_rate").alias("_dr"), F.col("area_km2").alias("_da"))
    lacking = base.where(F.col("_rate").isNull()).select("node", "_x")
    gap = F.abs(F.col("_x") - F.col("_y"))
    found = nearest(lacking, donors.select("donor", "_y"), ["_x"], ["_y"], "donor", "donor", gap).select("node", "donor")
    d = base.drop("_x").join(found.join(donors.drop("_y"), "donor"), "node", "left")
    inherited = F.col("_dr") * F.sqrt(F.greatest(F.col("_da"), F.lit(0.01)) / F.greatest(F.col("area_km2"), F.lit(0.01)))
    inherited = clip(inherited, floor_inherit, cap_inherit)
    raw = F.coalesce(F.col("_rate"), inherited, F.lit(0.005))
    floor = F.when(F.col("area_km2") < 25, 0.015).when(F.col("area_km2") < 100, 0.010).otherwise(0.005)
    bounded = F.least(F.greatest(raw, floor), F.lit(0.030))
    return d.withColumn("rate", F.when(F.col("is_tidal") | F.col("is_reservoir"), raw).otherwise(bounded)).drop("_rate", "_dr", "_da", "donor")
