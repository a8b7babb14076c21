"""Exact quantiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one
buffer. Here a mergeable sketch first brackets each wanted rank, and a second
pass counts what lies below the bracket and in each of many equal parts of it. Only the one or two parts that hold
the rank are ordered. The sketch and the parts decide how much is ranked, never the answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import cut

_ACCURACY = 10_000
#: Parts of a bracket: with brackets of 4 / _ACCURACY of the rows, one part of a group of 10 ** 10 rows holds some 4,000.
_PARTS = 1_000
#: Keys whose brackets are told to every task.
_FEW = 1_000


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int = _ACCURACY, slack: float | None = None
) -> DataFrame:
    """One row per key with one linearly interpolated quantile per entry of `probs`.

    Every rank is found among counted values; if one lay outside its bracket the query would fail, not give null.
    """
    keys = list(keys)
    names = list(probs)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    # The sketch errs by at most n / accuracy ranks. A bracket of twice that to both sides also holds the next rank, which
    # interpolation needs, once n reaches `accuracy`; with twice that many rows it does so with room to spare.
    slack, whole = (2.0 / accuracy if slack is None else slack), 2 * accuracy
    cuts = []
    for p in probs.values():
        cuts += [max(p - slack, 0.0), min(p + slack, 1.0)]
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", cuts, accuracy).alias("_cuts"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.count(F.lit(1)).alias("_n"),
    )
    brackets = []
    for i, p in enumerate(probs.values()):
        small = F.col("_n") <= whole
        lo = F.when(small | F.lit(p - slack <= 0), F.col("_min")).otherwise(F.get("_cuts", F.lit(2 * i)))
        hi = F.when(small | F.lit(p + slack >= 1), F.col("_max")).otherwise(F.get("_cuts", F.lit(2 * i + 1)))
        brackets.append(
            F.struct(F.lit(i).alias("q"), lo.alias("lo"), hi.alias("hi"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("pos"))
        )
    sketch = sketch.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.array(*brackets).alias("_b"))
    if keys:
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        sketch = cut(sketch)
        if sketch.limit(_FEW + 1).count() <= _FEW:  # few keys: joined by key, all rows of one would meet in one task
            sketch = F.broadcast(sketch)
        joined = rows.join(sketch, same, "inner").select(*keys, "_v", "_b")
    else:
        joined = rows.withColumn("_b", sketch.scalar())
    per_q = joined.select(*keys, "_v", F.explode("_b").alias("_q")).select(*keys, "_v", "_q.*")
    # values under the bracket collapse to one row per key, values above it are not needed
    part = F.when(F.col("_v") < F.col("lo"), -1).otherwise(F.least(F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("lo"), F.col("hi") - F.col("lo")) * _PARTS), F.lit(0)), F.lit(_PARTS)))
    counted = (
        per_q.where(F.col("_v") <= F.col("hi"))
        .withColumn("_part", part.cast("int"))
        .withColumn("_x", F.when(F.col("_part") >= 0, F.col("_v")))
        .groupBy(*keys, "q", "pos", "_part", "_x")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    low, high = F.floor("pos"), F.ceil("pos")
    upto = F.sum("_in").over(Window.partitionBy(*keys, "q").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    parts = counted.groupBy(*keys, "q", "pos", "_part").agg(F.sum("_c").alias("_in")).withColumn("_start", upto - F.col("_in"))
    whole_q = Window.partitionBy(*keys, "q")  # a row per part: a thousand at most
    inside = lambda at: (F.col("_part") >= 0) & (F.col("_start") <= at) & (at < F.col("_start") + F.col("_in"))
    parts = parts.withColumn("_found", F.max(inside(low)).over(whole_q) & F.max(inside(high)).over(whole_q))
    error = F.raise_error(F.lit("a quantile lies outside its bracket; raise the accuracy"))
    wanted = parts.where(F.when(F.col("_found"), inside(low) | inside(high)).otherwise(error.cast("boolean")))
    wanted = wanted.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("q").alias("_q"), F.col("_part").alias("_p"), "_start")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("q") == F.col("_q"), F.col("_part") == F.col("_p")]
    w = Window.partitionBy(*keys, "q", "_part").orderBy("_x")
    ranked = counted.join(wanted, same).withColumn("_upto", F.col("_start") + F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
    picked = ranked.groupBy(*keys, "q", "pos").agg(
        F.max(F.when((first <= low) & (low <= last), F.col("_x"))).alias("_a"),
        F.max(F.when((first <= high) & (high <= last), F.col("_x"))).alias("_z"),
    )
    val = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("pos") - F.floor("pos"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == i, val)).alias(n) for i, n in enumerate(names)]
    )
