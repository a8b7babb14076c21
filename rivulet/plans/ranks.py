"""Ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import cut


def neighbours_in_order(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value with the next smaller and the next larger one as `before` and `after`; the ends are null.

    Values are dealt by ranges and ordered inside them; only the ends of the ranges meet in one window.
    """
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(F.col(column)).sortWithinPartitions(column)
    rows = cut(rows.withColumn("_part", F.spark_partition_id()))
    ends = rows.groupBy("_part").agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    over = Window.orderBy("_part")
    ends = ends.select("_part", F.lag("_hi").over(over).alias("_down"), F.lead("_lo").over(over).alias("_up"))
    inside = Window.partitionBy("_part").orderBy(column)
    out = rows.withColumn("before", F.lag(column).over(inside)).withColumn("after", F.lead(column).over(inside)).join(ends, "_part")
    return out.select(column, F.coalesce("before", "_down").alias("before"), F.coalesce("after", "_up").alias("after"))


def value_counts_below(df: DataFrame, keys: Sequence[str], value: str, buckets: int | None = None) -> DataFrame:
    """Per key and distinct value: `n_equal`, `n_below` (rows with a smaller value) and `n_total`.

    Values are dealt into buckets by approximate quantiles, counted per bucket,
    and ordered only inside their bucket. The bucket edges are checkpointed, so
    the counting and the ordering pass see the same ones. Without a number of buckets there are as many as shuffle
    partitions (64 at least), so a key with very many values is spread over all of them.
    """
    keys = list(keys)
    buckets = buckets or max(64, min(5_000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_equal"))
    probs = [i / buckets for i in range(1, buckets)]
    edges = counts.groupBy(*keys).agg(F.percentile_approx(value, probs, max(1000, 10 * buckets)).alias("_edges"))
    edges = cut(edges).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_edges")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    tagged = counts.join(edges, same).withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col(value))))
    tagged = tagged.select(*keys, value, "n_equal", "_b")
    sizes = tagged.groupBy(*keys, "_b").agg(F.sum("n_equal").alias("_size"))
    wk = Window.partitionBy(*keys)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_ob"),
        F.coalesce(F.sum("_size").over(wk.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_size").over(wk).alias("n_total"))
    w = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("_before", F.coalesce(F.sum("n_equal").over(w), F.lit(0)))
    out = local.join(offsets, [*same, F.col("_b") == F.col("_ob")])
    return out.select(*keys, value, "n_equal", (F.col("_offset") + F.col("_before")).alias("n_below"), "n_total")
