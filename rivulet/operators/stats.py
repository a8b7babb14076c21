"""Thresholds, normalisation, correlation, histograms and roll-ups over series and nodes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.plans.fixpoint import cut
from rivulet.plans.quantiles import exact_quantiles
from rivulet.plans.timechunks import DAY, STEP, fdiv, micros

SERIES = ("series_id",)


# ------------------------------------------------------------- thresholds
def flood_thresholds(df: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value", slots_per_day: int = 96, min_year_frac: float = 0.8, min_readings: int = 100) -> DataFrame:
    """p75 and p90 of all readings, median and highest annual maximum of sufficiently complete years.

    Series with fewer than `min_readings` get nulls; the median needs two years.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull())
    year = F.year(ts)
    days = F.when((F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0)), 366).otherwise(365)
    yearly = df.groupBy(*keys, year.alias("_year"), days.alias("_days")).agg(F.count(F.lit(1)).alias("_rows"), F.count(value).alias("_n"), F.max(value).alias("_amax"))
    used = (F.col("_n") > 0) & (F.col("_n") / (F.col("_days") * slots_per_day) >= min_year_frac)
    dropped = (F.col("_n") > 0) & ~used
    # at most a few hundred years per series, so lists and the built-in percentile are bounded here
    per = yearly.groupBy(*keys).agg(
        F.sum("_n").alias("n_readings"), F.sum("_rows").alias("_rows"), F.count_if(used).alias("_years"), F.percentile(F.when(used, F.col("_amax")), 0.5).alias("_med"),
        F.max(F.when(used, F.col("_amax"))).alias("_high"),
        F.array_join(F.array_sort(F.collect_list(F.when(dropped, F.col("_year")))), ", ").alias("_dropped"))
    q = exact_quantiles(known, keys, value, {"_p75": 0.75, "_p90": 0.90})
    enough = F.col("n_readings") >= min_readings
    out = per.join(q, keys, "left")
    return out.select(
        *keys, "n_readings", (F.col("n_readings") / F.col("_rows")).alias("pct_valid"), F.when(enough, F.col("_p75")).alias("p75"), F.when(enough, F.col("_p90")).alias("p90"),
        F.when(enough, F.col("_years")).otherwise(0).alias("n_years_used"), F.when(enough & (F.col("_years") >= 2), F.col("_med")).alias("amax_med"),
        F.when(enough, F.col("_high")).alias("amax_high"), F.when(enough, F.col("_dropped")).otherwise("").alias("partial_years_dropped"))


def low_record(thresholds: DataFrame, min_years: int = 3) -> DataFrame:
    return thresholds.where(F.col("n_years_used") < min_years)


def write_back(stations: DataFrame, thresholds: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Station table with refreshed threshold columns; stations without p75 keep what they had."""
    fresh = thresholds.where(F.col("p75").isNotNull()).select(key, *[F.col(src).alias(f"_new_{dst}") for dst, src in columns.items()])
    out = stations.join(fresh, key, "left")
    return out.withColumns({dst: F.coalesce(F.col(f"_new_{dst}"), F.col(dst)) for dst in columns}).drop(*[f"_new_{d}" for d in columns])


def bankfull_fallback(train: DataFrame, flags: DataFrame, key: str = "series_id", value: str = "value") -> DataFrame:
    """max(min(1.3 max, 2 p99), 0.05); special nodes x1.5 up to 2; reliable where the maximum reaches p10 of all maxima.

    `flags` holds a boolean `special` (tidal or reservoir) per key. Nodes without data get 0.1, unreliable.
    """
    top = train.groupBy(key).agg(F.max(value).alias("_max"))
    p99 = exact_quantiles(train, [key], value, {"_p99": 0.99})
    floor = exact_quantiles(top, [], "_max", {"p": 0.10}).select("p").scalar()
    out = flags.join(top, key, "left").join(p99, key, "left").withColumn("_p10", floor)
    base = F.greatest(F.least(F.col("_max") * 1.3, F.col("_p99") * 2.0), F.lit(0.05))
    base = F.when(F.col("_max").isNull(), 0.1).otherwise(base)
    thr = F.when(F.col("special"), F.least(base * 1.5, F.lit(2.0))).otherwise(base)
    return out.select(key, F.greatest(thr, F.lit(0.05)).alias("bankfull"), F.coalesce(F.col("_max") >= F.col("_p10"), F.lit(False)).alias("reliable"))


def node_velocity(gaugings: DataFrame, nodes: DataFrame, key: str = "node", stage: str = "stage", velocity: str = "velocity", threshold: str = "bankfull", default: str = "default_velocity") -> DataFrame:
    """Median velocity above bankfull (<= 3 m/s, at least 2 rows), else of all rows (at least 3), else the class default."""
    g = gaugings.join(nodes.select(key, threshold), key)
    v = F.col(velocity)
    flood = g.where((F.col(stage) > F.col(threshold)) & (v <= 3.0))
    n = g.groupBy(key).agg(F.count(velocity).alias("_n"), F.count_if((F.col(stage) > F.col(threshold)) & (v <= 3.0)).alias("_nf"))
    out = nodes.join(n, key, "left").join(exact_quantiles(flood, [key], velocity, {"_vf": 0.5}), key, "left").join(exact_quantiles(g, [key], velocity, {"_va": 0.5}), key, "left")
    measured = F.when(F.col("_n") >= 3, F.coalesce(F.when(F.col("_nf") >= 2, F.col("_vf")), F.col("_va")))
    ok = (measured > 0.01) & (measured < 5.0)
    return out.select(key, F.when(ok, measured).otherwise(F.col(default)).alias("velocity"), F.when(ok, "gaugings").otherwise("default").alias("source"))


# ---------------------------------------------------------- normalisation
def robust_zscore(df: DataFrame, column: str, out: str) -> DataFrame:
    """(x - median) / population deviation; non-finite values take the median; a deviation of 0 counts as 1."""
    x = F.col(column)
    finite = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    med = exact_quantiles(finite.select(column), [], column, {"m": 0.5}).select("m").scalar()
    std = finite.agg(F.stddev_pop(column)).scalar()
    wide = df.withColumn("_m", med).withColumn("_s", std)
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    scale = F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return wide.withColumn(out, (F.when(good, x).otherwise(F.col("_m")) - F.col("_m")) / scale).drop("_m", "_s")


def norm_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median, population deviation and range per column: what undoes the normalisation."""
    long = df.select(F.expr("stack({}, {}) as (feature, value)".format(len(columns), ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)))).where("value is not null and not isnan(value)")
    base = long.groupBy("feature").agg(F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return base.join(exact_quantiles(long, ["feature"], "value", {"median": 0.5}), "feature")


def zscore_sample(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / max(sample deviation, 1e-6)."""
    moments = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns])).scalar()
    out = df.withColumn("_of", moments)
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col("_of")[f"m_{c}"]) / F.greatest(F.col("_of")[f"s_{c}"], F.lit(1e-6)))
    return out.drop("_of")


def train_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean_stage"))


def bankfull_anomaly(bankfull: DataFrame, datum: DataFrame, means: DataFrame, key: str = "node") -> DataFrame:
    """bankfull - datum - mean stage; nodes without a datum are left out."""
    return bankfull.join(datum.where(F.col("datum").isNotNull()), key).join(means, key).withColumn("bankfull_anomaly", F.col("bankfull") - F.col("datum") - F.col("mean_stage"))


def reference_discharge(train: DataFrame, value: str, floor: float = 0.01) -> DataFrame:
    return train.agg(F.greatest(F.avg(value), F.lit(floor)).alias("q_ref"))


# ---------------------------------------------------------- distributions
def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 80) -> DataFrame:
    """Equal bins between minimum and maximum of each key; the last bin is closed; density integrates to 1.

    A constant series gets a range of half a unit to both sides.
    """
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    pad = F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise(0.0)
    span = span.withColumn("_pad", pad).withColumn("_lo", F.col("_lo") - F.col("_pad")).withColumn("_hi", F.col("_hi") + F.col("_pad")).drop("_pad")
    width = (F.col("_hi") - F.col("_lo")) / bins
    binned = df.where(F.col(value).isNotNull()).join(span, list(keys)).withColumn("bin", F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)))
    out = binned.groupBy(*keys, "bin", "_lo", "_hi", "_n").agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "bin", "n", (F.col("n") / (F.col("_n") * width)).alias("density"))


# ------------------------------------------------------------ correlation
def correlation_matrix(grid: DataFrame, pairs: DataFrame | None = None, key: str = "series_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """Pairwise-complete Pearson correlation (a, b, n, corr) of the given pairs (a, b), or of all pairs a <= b.

    Give `pairs` for more than a few hundred series: the matrix of all has a row per pair. Values meet by an equi join on time
    and are summed at once by built-in aggregates, so one time step is the largest unit; values are centred first to keep digits.
    """
    means = grid.groupBy(key).agg(F.avg(value).alias("_mean"))
    rows = grid.where(F.col(value).isNotNull()).join(means, key).groupBy(F.col(key).alias("k"), F.col(ts).alias("at")).agg(F.avg(F.col(value) - F.col("_mean")).alias("v"))
    left, right = rows.select(F.col("k").alias("a"), "at", F.col("v").alias("x")), rows.select(F.col("k").alias("b"), "at", F.col("v").alias("y"))
    met = left.join(right, "at").where("a <= b") if pairs is None else left.join(pairs.select("a", "b").distinct(), "a").join(right, ["b", "at"])
    x, y = F.col("x"), F.col("y")
    s = met.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sa"), F.sum(y).alias("sb"), F.sum(x * x).alias("saa"), F.sum(y * y).alias("sbb"), F.sum(x * y).alias("sab"))
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    den = F.sqrt((F.col("saa") - F.col("sa") ** 2 / n) * (F.col("sbb") - F.col("sb") ** 2 / n))
    return s.where(n > 1).select("a", "b", "n", F.when(den > 0, cov / den).alias("corr"))


def lagged_products(series: DataFrame, pairs: DataFrame, lo: int, hi: int, step: int, key: str = "series_id", ts: str = "ts", value: str = "value", block_steps: int = 2880) -> DataFrame:
    """sum over s of b[s + lag] * a[s] for every pair (a, b) and lag in [lo, hi]; missing terms count as 0."""
    base = series.where(F.col(value).isNotNull() & (F.col(value) != 0)).select(F.col(key).alias("_k"), micros(ts).alias("us"), F.col(value).cast("double").alias("v"))
    one = lambda side: base.join(pairs.select("a", "b"), F.col("_k") == F.col(side)).select("a", "b", "us", "v")
    return _lag_sums(one("a"), one("b"), lo, hi, step, block_steps)


def _lag_sums(left: DataFrame, right: DataFrame, lo: int, hi: int, step: int, block_steps: int = 2880) -> DataFrame:
    """Lagged sums of products from rows (a, b, us, v) of both sides.

    Work is split by (pair, time block): a block's own left values meet the right values of the block widened by the lag range. All
    lags of a block come from one product of spectra (overlap-save: the transform is long enough that nothing wraps into them), so the
    cost does not grow with their number. A block is at least as long as the lag range, so that no value is copied to more than three.
    """
    block_steps = max(block_steps, hi - lo + 1)
    size, length = block_steps * step, 1 << (block_steps + hi - lo).bit_length()
    a = left.select("a", "b", "us", "v", F.lit(0).alias("side")).withColumn("blk", fdiv(F.col("us"), size))
    b = right.select("a", "b", "us", "v", F.lit(1).alias("side")).withColumn(
        "blk", F.explode(F.sequence(fdiv(F.col("us") - hi * step, size), fdiv(F.col("us") - lo * step, size))))
    types = {f.name: f.dataType.simpleString() for f in left.schema}

    def dot(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = ((pdf["us"].to_numpy() - key_[2] * size) // step).astype(int)
        side, v = pdf["side"].to_numpy(), pdf["v"].to_numpy()
        x, y = np.zeros(block_steps), np.zeros(block_steps + hi - lo)
        x[at[side == 0]] = v[side == 0]
        y[at[side == 1] - lo] = v[side == 1]
        sums = np.fft.irfft(np.fft.rfft(x, length).conj() * np.fft.rfft(y, length), length)[: hi - lo + 1]
        return pd.DataFrame({"a": key_[0], "b": key_[1], "lag": range(lo, hi + 1), "s": sums})

    parts = a.unionByName(b).groupBy("a", "b", "blk").applyInPandas(dot, f"a {types['a']}, b {types['b']}, lag int, s double")
    return parts.groupBy("a", "b", "lag").agg(F.sum("s").alias("s"))


def lag_correlation(rain: DataFrame, level_change: DataFrame, pairs: DataFrame, max_lag: int, step: int, key: str = "series_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """Cross-correlation of level change after rain over lags 0..max_lag: the curve of each (rain a, level b) pair.

    Both sides are z-scored with std_pop + 1e-9 over their whole record.
    """
    both = rain.select(key, ts, value).unionByName(level_change.select(key, ts, value))
    st = both.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    z = both.join(st, key).select(key, ts, ((F.col(value) - F.col("_m")) / (F.col("_s") + 1e-9)).alias(value))
    sums = lagged_products(z, pairs, 0, max_lag, step, key, ts, value)
    n = st.select(F.col(key).alias("b"), F.col("_n"))
    return sums.join(n, "b").select("a", "b", "lag", (F.col("s") / F.col("_n")).alias("xcorr"))


def peak_lag(curve: DataFrame) -> DataFrame:
    """Lag of the highest correlation, the smallest on a tie."""
    return curve.groupBy("a", "b").agg(F.max(F.struct("xcorr", (-F.col("lag")).alias("neg"))).alias("_m")).select("a", "b", (-F.col("_m.neg")).alias("peak_lag"), F.col("_m.xcorr").alias("peak_corr"))


def routing_lags(series: DataFrame, pairs: DataFrame, max_lag: int = 48, step: int = STEP, min_valid: int = 500, min_corr: float = 0.5, min_events: int = 3, key: str = "series_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """Empirical lag of every edge a -> b from the peak of the cross-correlation; null where not accepted."""
    means = series.groupBy(key).agg(F.avg(value).alias("_m"))
    c = series.where(F.col(value).isNotNull()).join(means, key).select(key, ts, F.col(value).alias("_raw"), (F.col(value) - F.col("_m")).alias("v"))
    # values without a valid partner at the same step count as 0, so they are left out per pair
    left = c.join(pairs.select("a", "b"), F.col(key) == F.col("a")).select("a", "b", ts, F.col("v").alias("va"), F.col("_raw").alias("ra"))
    right = c.join(pairs.select("a", "b"), F.col(key) == F.col("b")).select("a", "b", ts, F.col("v").alias("vb"))
    both = left.join(right, ["a", "b", ts])
    st = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_valid"), F.stddev_pop("va").alias("_sa"), F.stddev_pop("vb").alias("_sb"))
    p80 = exact_quantiles(both, ["a", "b"], "ra", {"_p80": 0.8})
    high = both.join(p80, ["a", "b"]).groupBy("a", "b").agg(F.count_if(F.col("ra") > F.col("_p80")).alias("n_high"))
    at = micros(ts).alias("us")
    sums = _lag_sums(both.select("a", "b", at, F.col("va").alias("v")), both.select("a", "b", at, F.col("vb").alias("v")), -max_lag, max_lag, step)
    peak = sums.groupBy("a", "b").agg(F.max(F.struct("s", (-F.col("lag")).alias("neg"))).alias("_m"))
    out = st.join(peak, ["a", "b"], "left").join(high, ["a", "b"], "left")
    corr = F.col("_m.s") / (F.col("_sa") * F.col("_sb") * F.col("n_valid") + 1e-8)
    lag = -F.col("_m.neg")
    ok = (F.col("n_valid") >= min_valid) & (F.col("n_high") >= 4 * min_events) & (corr > min_corr) & (lag > 0)
    return out.select("a", "b", "n_valid", lag.alias("best_lag"), corr.alias("best_corr"), F.when(ok, lag).alias("empirical_lag"))


def merge_lags(empirical: DataFrame, kinematic: DataFrame, keys: Sequence[str] = ("src", "dst")) -> DataFrame:
    """Empirical lag where accepted, else the kinematic one."""
    return kinematic.join(empirical.select(*keys, "empirical_lag"), list(keys), "left").select(
        *keys, F.coalesce("empirical_lag", "kinematic_lag").alias("lag_steps"), F.when(F.col("empirical_lag").isNotNull(), "empirical").otherwise("kinematic").alias("source"))


# -------------------------------------------------------------- similarity
def _centred(df: DataFrame, key: str, vec: str, *further: Column) -> DataFrame:
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    d = df.select(F.col(key).alias("k"), v.alias("v"), *further)
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    d = d.withColumn("_m", mean).withColumn("v", F.transform("v", lambda x: x - F.col("_m"))).drop("_m")
    return d.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def wetness_similarity(df: DataFrame, key: str, vec: str, block_rows: int = 500) -> DataFrame:
    """Cosine of mean-centred vectors for every pair a <= b, bounded to [-1, 1], 1 on the diagonal.

    The matrix is the result, so it is produced block by block: vectors are dealt into groups of about `block_rows`, a group is one row, and
    each pair of groups is one matrix product. Vectors are shuffled once, as they come; groups are written once and read again by each task that
    pairs them, so the disk holds the vectors and not a copy per group.
    """
    blocks = max(1, -(-df.count() // block_rows))
    tasks = -(-blocks // 8)  # 64 pairs of groups to a task
    rows = df.where(F.col(key).isNotNull()).select(key, vec, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_g")).repartitionByRange(tasks, "_g")
    packed = _centred(rows, key, vec, F.col("_g").alias("g")).groupBy("g").agg(F.collect_list(F.struct("k", "v", "norm")).alias("s")).select("g", F.col("s.k").alias("k"), F.col("s.v").alias("v"), F.col("s.norm").alias("norm"))
    packed = cut(packed).coalesce(tasks)  # never more, as tasks meet two by two
    other = packed.select(F.col("g").alias("g2"), F.col("k").alias("k2"), F.col("v").alias("v2"), F.col("norm").alias("norm2"))
    kt = df.schema[key].dataType.simpleString()

    def stacked(vectors: np.ndarray) -> np.ndarray:
        size = max((len(x) for x in vectors if x is not None), default=0)
        return np.stack([np.full(size, np.nan) if x is None else x for x in vectors])

    def cosine(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                den = np.maximum(np.outer(r.norm, r.norm2), 1e-12)
                sim = np.clip(stacked(r.v) @ stacked(r.v2).T / den, -1.0, 1.0)
                ka, kb = np.repeat(r.k, len(r.k2)), np.tile(r.k2, len(r.k))
                flat = np.where(ka == kb, 1.0, sim.ravel())
                keep = np.ones(len(flat), bool) if r.g != r.g2 else ka <= kb
                yield pd.DataFrame({"a": np.minimum(ka, kb)[keep], "b": np.maximum(ka, kb)[keep], "similarity": flat[keep]})

    return packed.join(other, F.col("g") <= F.col("g2")).mapInPandas(cosine, f"a {kt}, b {kt}, similarity double")


def similar_pairs(df: DataFrame, key: str, vec: str, threshold: float, pivots: int = 64, block_rows: int = 2000) -> DataFrame:
    """Pairs a < b whose mean-centred vectors have a cosine of at least `threshold` (above -1), without forming the others where angles rule them out.

    At most `pivots` vectors, the first by a hash of the key, are centres; each vector is at home with the nearest one. A vector can be similar to one at home
    elsewhere only if its angle to that centre is at most the home's widest angle plus that of the threshold, so it visits only such homes. What is skipped
    depends on the data: on vectors without any structure nothing is. Homes and their visitors are cut into groups of about
    `block_rows` on each side, so no task holds more. Vectors that are null, empty or constant are similar to nothing; so are two of unequal length.
    """
    c = _centred(df.where(F.col(vec).isNotNull()), key, vec).where("norm > 0").withColumn("size", F.size("v"))
    unit = cut(c.select("k", "size", F.transform("v", lambda x: x / F.col("norm")).alias("u")))
    schema = dict(unit.dtypes)
    centres = [(r["size"], r["u"]) for r in unit.orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(pivots).collect()]
    reach = float(np.arccos(np.clip(threshold, -1.0, 1.0)))

    def angles(part: pd.DataFrame) -> np.ndarray:
        """Angle of each vector to each centre; none where lengths differ."""
        out = np.full((len(part), len(centres)), np.inf)
        for size in part["size"].unique():
            rows, own = np.flatnonzero(part["size"] == size), [i for i, (n, _) in enumerate(centres) if n == size]
            if own:
                out[np.ix_(rows, own)] = np.arccos(np.clip(np.stack(part["u"].to_numpy()[rows]) @ np.array([centres[i][1] for i in own]).T, -1.0, 1.0))
        return out

    def settle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            a = angles(part)
            home = np.where(np.isfinite(a.min(axis=1)), a.argmin(axis=1), -1)  # vectors of lengths without a centre share the last home
            yield part.assign(home=home.astype("int32"), angle=np.where(home >= 0, a.min(axis=1), np.pi))

    columns = f"k {schema['k']}, size int, u array<double>"
    homes = cut(unit.mapInPandas(settle, f"{columns}, home int, angle double"))
    held = {r["home"]: (r["r"], r["n"]) for r in homes.groupBy("home").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()}
    blocks = {h: max(1, -(-n // block_rows)) for h, (_, n) in held.items()}

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            a = angles(part)
            own = part["home"].to_numpy()
            for h, (widest, _) in held.items():
                near = np.ones(len(part), bool) if h < 0 else ~(a[:, h] > widest + reach + 1e-9)
                rows = part[near & (own < h)]
                for block in range(blocks[h]):
                    yield rows[["k", "size", "u"]].assign(home=np.int32(h), block=np.int32(block), side=np.int32(1))
                for block in range(blocks[h]):  # at home: as a row, and as a visitor of every block
                    mine = part[own == h]
                    yield mine[["k", "size", "u"]].assign(home=np.int32(h), block=np.int32(block), side=np.int32(2))

    dealt = lambda n, salt: F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(salt)), n).cast("int")
    n_blocks = F.coalesce(*[F.when(F.col("home") == h, F.lit(b)) for h, b in blocks.items()], F.lit(1))
    n_guests = max(1, -(-sum(n for _, n in held.values()) // (4 * block_rows)))
    at_home = homes.select("home", dealt(n_blocks, 0).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_guests - 1))).alias("guest"), "k", "size", "u", F.lit(0).alias("side"))
    visits = homes.mapInPandas(visit, f"{columns}, home int, block int, side int")
    rows = at_home.unionByName(visits.withColumn("guest", dealt(F.lit(n_guests), 1)))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        for size in part["size"].unique():
            own, met = part[(part["side"] == 0) & (part["size"] == size)], part[(part["side"] > 0) & (part["size"] == size)]
            if len(own) and len(met):
                sim = np.clip(np.stack(own["u"]) @ np.stack(met["u"]).T, -1.0, 1.0)
                i, j = np.nonzero(sim >= threshold)
                a, b = own["k"].to_numpy()[i], met["k"].to_numpy()[j]
                once = (met["side"].to_numpy()[j] == 1) & (a != b) | (a < b)  # two at home meet in both orders
                found.append(pd.DataFrame({"a": np.minimum(a, b)[once], "b": np.maximum(a, b)[once], "similarity": sim[i, j][once]}))
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "similarity": []})

    return rows.groupBy("home", "block", "guest").applyInPandas(compare, f"a {schema['k']}, b {schema['k']}, similarity double")


def similarity_on_edges(df: DataFrame, edges: DataFrame, key: str, vec: str) -> DataFrame:
    """Similarity of the two ends of each edge: only the pairs that are edges are ever formed."""
    c = _centred(df, key, vec)
    s = c.select(F.col("k").alias("src"), F.col("v").alias("_va"), F.col("norm").alias("_na"))
    d = c.select(F.col("k").alias("dst"), F.col("v").alias("_vb"), F.col("norm").alias("_nb"))
    dot = F.aggregate(F.zip_with("_va", "_vb", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    sim = F.least(F.greatest(dot / F.greatest(F.col("_na") * F.col("_nb"), F.lit(1e-12)), F.lit(-1.0)), F.lit(1.0))
    return edges.join(s, "src").join(d, "dst").withColumn("similarity", F.when(F.col("src") == F.col("dst"), 1.0).otherwise(sim)).drop("_va", "_vb", "_na", "_nb")


def similarity_summary(pairs: DataFrame, high: float = 0.7, low: float = -0.3) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("similarity") > high).alias("n_high"), F.count_if(F.col("similarity") < low).alias("n_low"), F.avg("similarity").alias("mean"))


# ----------------------------------------------------------------- roll-up
def summary_rows(grid: DataFrame, events: DataFrame, lags: DataFrame, key: str = "series_id", value: str = "value", top: int = 5) -> DataFrame:
    """Roll-up as (section, item, value): completeness, range, totals, events, longest events, lags, suggestions."""
    def rows(df: DataFrame, section: str, item: Column, val: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), val.cast("double").alias("value"))

    g = grid.groupBy(key).agg((F.avg(F.col(value).isNotNull().cast("double")) * 100).alias("c"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(value).alias("tot"))
    ev = events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_h").alias("h"), F.max("peak").alias("p"))
    w = Window.partitionBy(key).orderBy(F.desc("duration_h"), "start")
    longest = events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    top_lag = lags.agg(F.max("peak_lag").alias("m"))
    hours = grid.agg((F.count_distinct("ts") / 4).alias("h")).scalar()
    imb = events.agg(F.sum("duration_h").alias("s")).withColumn("_h", hours)
    parts = [
        rows(g, "completeness_pct", F.col(key), F.col("c")), rows(g, "min", F.col(key), F.col("lo")), rows(g, "max", F.col(key), F.col("hi")), rows(g, "total", F.col(key), F.col("tot")),
        rows(ev, "n_events", F.col(key), F.col("n")), rows(ev, "event_hours", F.col(key), F.col("h")), rows(ev, "max_peak", F.col(key), F.col("p")),
        rows(longest, "longest_event_h", F.concat_ws("#", F.col(key), F.col("_r")), F.col("duration_h")),
        rows(top_lag, "max_lag_h", F.lit("all"), F.col("m")), rows(top_lag, "suggested_input_h", F.lit("all"), F.greatest(F.lit(24), F.col("m") + 6)),
        rows(imb, "event_share_pct", F.lit("all"), F.col("s") / F.greatest(F.col("_h"), F.lit(1.0)) * 100),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
