"""Quality control: range and code masks, duplicates, gaps, audits and rule tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.plans.intervals import interval_join
from rivulet.plans.quantiles import exact_quantiles
from rivulet.plans.runs import find_runs
from rivulet.plans.timechunks import DAY, HOUR, STEP, fdiv, from_micros, micros

SERIES = ("series_id",)

# fixed values: accepted range per kind, codes that mean a bad reading, code of a good one
RANGES = {"level": (0.0, 125.0), "discharge": (0.0, 175.0), "rainfall": (0.0, 100.0)}
BAD_CODES = (-1, 32, 101)
GOOD_CODE = 254


def range_filter(df: DataFrame, value: str = "value", kind: str = "kind") -> DataFrame:
    """Readings outside their kind's range become null; the row stays."""
    ok = F.lit(False)
    for name, (lo, hi) in RANGES.items():
        ok = ok | ((F.col(kind) == name) & F.col(value).between(lo, hi))
    return df.withColumn(value, F.when(ok, F.col(value)))


def mask_bad_codes(df: DataFrame, value: str = "value", code: str = "quality_code", bad: Sequence[int] = BAD_CODES, good: int = GOOD_CODE) -> DataFrame:
    return df.withColumn(value, F.when(~F.coalesce(F.col(code).isin(*bad), F.lit(False)), F.col(value))).withColumn(
        "quality_ok", F.coalesce(F.col(code) == good, F.lit(False)))


def drop_negative(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.when(F.col(value) >= 0, F.col(value)))


def first_per_timestamp(df: DataFrame, order: str, keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """One row per (series, timestamp): the first in ingest order, chosen by a mergeable minimum."""
    rest = [c for c in df.columns if c not in (*keys, ts)]
    best = df.groupBy(*keys, ts).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("_r"))
    return best.select(*keys, ts, *[F.col(f"_r.{c}").alias(c) for c in rest])


def find_gaps(grid: DataFrame, min_hours: float = 6.0, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value", step: int = STEP) -> DataFrame:
    """Null stretches of a complete grid of at least `min_hours`.

    A gap ends at the first valid step; a trailing one at the last step of the grid.
    """
    runs = find_runs(grid.where(F.col(value).isNull()), keys, ts, step)
    last = grid.groupBy(*keys).agg(F.max(ts).alias("_last"))
    end = F.least(from_micros(micros("run_end") + step), F.col("_last"))
    hours = (micros(end) - micros("run_start")) / HOUR
    return runs.join(last, list(keys)).select(*keys, F.col("run_start").alias("start"), end.alias("end"), hours.alias("duration_hours")).where(
        F.col("duration_hours") >= min_hours)


def quality_report(grid: DataFrame, gaps: DataFrame, min_completeness: float = 0.7, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Per station: totals, completeness, verdict, number and longest of its gaps."""
    totals = grid.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_steps"), F.count(value).alias("valid_steps"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    by_gap = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gaps"), F.max("duration_hours").alias("longest_gap_h"))
    frac = F.col("valid_steps") / F.col("total_steps")
    return totals.join(by_gap, list(keys), "left").select(
        *keys, "total_steps", "valid_steps", (frac * 100).alias("completeness_pct"), (frac >= min_completeness).alias("passes"),
        F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), F.coalesce("longest_gap_h", F.lit(0.0)).alias("longest_gap_h"), "min_value", "max_value")


def coverage_diagnosis(df: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value", code: str = "quality_code", step: int = STEP) -> DataFrame:
    """Code histogram entries (readings, values and timestamps that failed to parse), and per series the first and last valid
    reading, the largest gap between valid readings in steps, and the share of valid readings."""
    per_code = df.groupBy(*keys, code).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("n_unparsed"), F.count_if(F.col(ts).isNull()).alias("n_bad_ts"),
        F.min(F.when(F.col(value).isNotNull(), F.col(ts))).alias("first_valid"), F.max(F.when(F.col(value).isNotNull(), F.col(ts))).alias("last_valid"))
    w = Window.partitionBy(*keys)
    days = df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(*keys, micros(ts).alias("_us"), fdiv(micros(ts), DAY).alias("_day"))
    inner = Window.partitionBy(*keys, "_day").orderBy("_us")
    inside = days.withColumn("_gap", F.col("_us") - F.lag("_us").over(inner)).groupBy(*keys, "_day").agg(F.max("_gap").alias("_in"), F.min("_us").alias("_a"), F.max("_us").alias("_z"))
    across = inside.withColumn("_gap", F.greatest("_in", F.col("_a") - F.lag("_z").over(Window.partitionBy(*keys).orderBy("_day"))))  # one row per day
    gaps = across.groupBy(*keys).agg((F.max("_gap") / step).alias("largest_gap_steps"))
    return per_code.join(gaps, list(keys), "left").select(
        *keys, code, "n", "n_unparsed", "n_bad_ts", "largest_gap_steps", ((F.sum("n").over(w) - F.sum("n_unparsed").over(w)) / F.sum("n").over(w)).alias("coverage"), F.min("first_valid").over(w).alias("first_valid"), F.max("last_valid").over(w).alias("last_valid"),
        (F.sum("n").over(w)).alias("n_total"))


def _column_stats(by: list[str]) -> list[Column]:
    v = F.col("value")
    return [
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        (F.try_divide(F.count_if(v == 0), F.count(v)) * 100).alias("pct_zero"), (F.count_if(v.isNull()) / F.count(F.lit(1)) * 100).alias("pct_null"),
        F.count(F.lit(1)).alias("n"),
    ]


def feature_audit(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), zero_ok: Sequence[str] = ("discharge_m3s",)) -> DataFrame:
    """Statistics and flags per feature (and group): one unpivot, one mergeable aggregate."""
    long = df.select(*by, F.expr("stack({}, {}) as (feature, value)".format(
        len(features), ", ".join(f"'{f}', cast(`{f}` as double)" for f in features))))
    out = long.groupBy(*by, "feature").agg(*_column_stats(list(by)))
    flags = F.filter(
        F.array(
            F.when(F.col("min").isNull(), "all null"),
            F.when(F.col("std") < 1e-6, "constant"),
            F.when((F.col("pct_zero") > 95) & ~F.col("feature").isin(*zero_ok), "mostly zero"),
            F.when(F.col("pct_null") > 5, "many nulls"),
        ),
        lambda x: x.isNotNull(),
    )
    return out.withColumn("flags", F.array_join(flags, "; "))


def array_summary(df: DataFrame, value: str) -> DataFrame:
    """Size, null, NaN and infinite counts and moments of one column."""
    v = F.col(value).cast("double")
    inf = F.abs(v) == float("inf")
    ok = F.when(~F.isnan(v) & ~inf, v)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("n_null"), F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(inf).alias("n_inf"),
        F.min(ok).alias("min"), F.max(ok).alias("max"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("std"))


def node_coverage(df: DataFrame, valid: Column, key: str = "series_id", low: float = 0.5) -> DataFrame:
    out = df.groupBy(key).agg(F.avg(valid.cast("double")).alias("coverage"))
    return out.withColumn("low", F.col("coverage") < low).orderBy("coverage", key)


def cross_check_keys(facts: DataFrame, dims: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Distinct keys on both sides and those missing on the other one."""
    both = facts.select(F.col(key).alias("_f")).distinct().join(dims.select(F.col(dim_key).alias("_d")).distinct(), F.col("_f") == F.col("_d"), "full_outer")
    return both.agg(
        F.count("_f").alias("n_fact_keys"), F.count("_d").alias("n_dim_keys"),
        F.count_if(F.col("_d").isNull()).alias("missing_in_dim"), F.count_if(F.col("_f").isNull()).alias("missing_in_fact"))


def declared_flag_mismatch(df: DataFrame, declared: DataFrame, key: str, value: str, flag: str, max_zero: float = 0.99) -> DataFrame:
    """Nodes whose declared flag disagrees with the data: data present means fewer than 99% zeros."""
    seen = df.groupBy(key).agg((F.count_if(F.coalesce(value, F.lit(0.0)) == 0) / F.count(F.lit(1))).alias("zero_share"))
    out = declared.select(key, flag).join(seen, key).withColumn("observed", F.col("zero_share") < max_zero)
    return out.where(F.col(flag) != F.col("observed"))


def duplicate_keys(df: DataFrame, keys: Sequence[str], focus: Column | None = None) -> DataFrame:
    """Key combinations that occur more than once, optionally only those with a focus value."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    return out if focus is None else out.where(focus)


def check_rules(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Evaluate (measured value, pass condition on it) pairs as one aggregate; one row per rule."""
    agg = df.agg(*[m.cast("double").alias(name) for name, (m, _) in rules.items()])
    rows = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("value"), F.when(ok, "ok").otherwise("fail").alias("status")) for n, (_, ok) in rules.items()]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def validate_gridded(cells: DataFrame, layers: Sequence[str], n_nodes: int | Column, key: str = "cell_id", ts: str = "ts") -> DataFrame:
    """Null share, value range, repeated time steps and node count of a gridded table.

    Rows of a table have no order of their own, so what a file's order would show as time standing still is
    found as more than one row of a cell at a time.
    """
    rules: dict[str, tuple[Column, Column]] = {}
    for layer in layers:
        v = F.col(layer)
        rules[f"{layer}_null_share"] = (F.avg(v.isNull().cast("double")), F.col(f"{layer}_null_share") <= 0.05)
        rules[f"{layer}_out_of_range"] = (F.count_if((v < -0.01) | (v > 0.65)), F.col(f"{layer}_out_of_range") == 0)
        rules[f"{layer}_mean"] = (F.avg(v), F.col(f"{layer}_mean").between(0.20, 0.47))
    rules["repeated_steps"] = (F.count(F.lit(1)) - F.count_distinct(F.struct(key, ts)), F.col("repeated_steps") == 0)
    rules["node_count"] = (F.count_distinct(key), F.col("node_count") == n_nodes)
    return check_rules(cells, rules)


def mean_plausibility(cells: DataFrame, layer: str, by: Sequence[str], lo: float = 0.20, hi: float = 0.47) -> DataFrame:
    m = F.col("mean")
    verdict = F.when(m.isNull() | (F.abs(m) < 1e-3), "empty").when(m.between(lo, hi), "plausible").otherwise("implausible")
    return cells.groupBy(*by).agg(F.avg(layer).alias("mean")).withColumn("verdict", verdict)


def parameter_audit(params: DataFrame, value: str, by: Sequence[str], lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Share of runs whose parameter lies outside [lo, hi], called systemic, partial or none."""
    out = params.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(value).between(lo, hi)).alias("n_out"))
    share = F.col("n_out") / F.col("n")
    return out.withColumn("share_out", share).withColumn("verdict", F.when(share == 1, "systemic").when(share > 0, "partial").otherwise("none"))


def gate_lead(df: DataFrame, window_keys: Sequence[str], step: str, gate: Column, crossed: Column) -> DataFrame:
    """Steps by which the gate opens (>= 0.5) before the threshold is crossed; null if it never opens."""
    return df.groupBy(*window_keys).agg(
        F.min(F.when(gate >= 0.5, F.col(step))).alias("gate_step"), F.min(F.when(crossed, F.col(step))).alias("cross_step"),
    ).withColumn("lead_steps", F.col("cross_step") - F.col("gate_step")).withColumn(
        "outcome", F.when(F.col("gate_step").isNull(), "never opens").when(F.col("cross_step").isNull(), "never crosses").when(F.col("lead_steps") >= 0, "leads").otherwise("lags"))


def physical_guards(df: DataFrame, features: Sequence[str], rain: str | None = None, saturation: str | None = None, norm: str | None = None, factor: float = 3.0) -> DataFrame:
    """Clip features to +- factor x p99 of their absolute value, rain to >= 0, saturation to [0,1], position to [-2,5]."""
    sizes = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(F.col(f)).cast("double").alias("size")) for f in features])).alias("_x")).select("_x.*")
    limits = exact_quantiles(sizes, ["feature"], "size", {"p": 0.99})  # one pass for all features, one row each
    out = df.withColumn("_lim", limits.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.col("p") * factor)))).scalar())
    for f in features:
        limit = F.col("_lim")[f]
        out = out.withColumn(f, F.when(F.col(f).isNotNull(), F.least(F.greatest(F.col(f), -limit), limit)))
    out = out.drop("_lim")
    from rivulet.functions.expr import clip

    for name, lo, hi in ((rain, 0.0, None), (saturation, 0.0, 1.0), (norm, -2.0, 5.0)):
        if name:
            out = out.withColumn(name, clip(F.col(name), lo, hi))
    return out


def merge_intervals(df: DataFrame, key: str, start: str, end: str, chunk: int = DAY) -> DataFrame:
    """Overlapping or touching intervals of a key become one, whatever their lengths. Intervals that end before they start are dropped.

    Intervals are dealt by the time slice in which they start. What reaches into a slice is the latest end of all earlier slices, one
    number per slice; with it each slice finds its own groups. Only the group that goes on from before and the last one of
    a slice can belong together with others, so only those go through a window over the whole key.
    """
    rows = df.where(F.col(start) <= F.col(end)).select(key, F.col(start).alias("_s"), F.col(end).alias("_e")).withColumn("_slice", fdiv(micros("_s"), chunk))
    slices = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(key, "_slice").agg(F.max("_e").alias("_r")).withColumn("_reach", F.max("_r").over(slices)).drop("_r")
    inside = Window.partitionBy(key, "_slice").orderBy("_s", "_e")
    before = F.greatest("_reach", F.max("_e").over(inside.rowsBetween(Window.unboundedPreceding, -1)))  # nulls are skipped
    marked = rows.join(reach, [key, "_slice"]).withColumn("_new", (before.isNull() | (F.col("_s") > before)).cast("int"))
    marked = marked.withColumn("_g", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    groups = marked.groupBy(key, "_slice", "_g").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    groups = groups.withColumn("_last", F.max("_g").over(Window.partitionBy(key, "_slice")))
    open_ = (F.col("_g") == 0) | (F.col("_g") == F.col("_last"))
    order = Window.partitionBy(key).orderBy("_slice", "_g").rowsBetween(Window.unboundedPreceding, 0)
    edge = groups.where(open_).withColumn("_n", F.sum((F.col("_g") > 0).cast("int")).over(order)).groupBy(key, "_n").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    both = groups.where(~open_).select(key, "_s", "_e").unionByName(edge.select(key, "_s", "_e"))
    return both.withColumnsRenamed({"_s": start, "_e": end})


def mask_outages(df: DataFrame, outages: DataFrame, columns: Sequence[str], key: str = "node", ts: str = "ts", start: str = "start", end: str = "end") -> DataFrame:
    """Null the columns of rows inside an outage [start, end) of their node.

    Outages of a node are merged first, so a row meets at most one and is never doubled.
    """
    disjoint = merge_intervals(outages, key, start, end).withColumnsRenamed({start: "_from", end: "_until"})
    out = interval_join(df, disjoint, ts, "_from", "_until", on=[key], how="left", closed=False, bucket=30 * DAY)
    hit = F.col("_from").isNotNull()
    return out.withColumns({c: F.when(~hit, F.col(c)) for c in columns}).withColumn("masked", hit).drop("_from", "_until")


def drop_profile_outliers(points: DataFrame, keys: Sequence[str], elev: str, sigmas: float = 3.0) -> DataFrame:
    """Keep profile points nearer than `sigmas` population deviations to the median of their profile."""
    med = exact_quantiles(points, keys, elev, {"_med": 0.5})
    spread = points.groupBy(*keys).agg(F.stddev_pop(elev).alias("_std"))
    ref = med.join(spread, list(keys))
    return points.join(ref, list(keys)).where(F.abs(F.col(elev) - F.col("_med")) < sigmas * F.col("_std")).drop("_med", "_std")


def score_gap(recomputed: DataFrame, stored: DataFrame, keys: Sequence[str], score: str = "nse", tolerance: float = 0.05) -> DataFrame:
    both = recomputed.select(*keys, F.col(score).alias("recomputed")).join(stored.select(*keys, F.col(score).alias("stored")), list(keys))
    gap = F.abs(F.col("recomputed") - F.col("stored"))
    return both.withColumn("gap", gap).withColumn("verdict", F.when(gap < tolerance, "ok").otherwise("check"))


def download_summary(df: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value", kind: str = "kind") -> DataFrame:
    """Rows, period, missing share and mean (rain: total) per station."""
    return df.groupBy(*keys, kind).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        (F.avg(F.col(value).isNull().cast("double")) * 100).alias("missing_pct"), F.avg(value).alias("_mean"), F.sum(value).alias("_total"),
    ).withColumn("mean_or_total", F.when(F.col(kind) == "rainfall", F.col("_total")).otherwise(F.col("_mean"))).drop("_mean", "_total")
