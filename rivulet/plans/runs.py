"""Runs of neighbouring rows (gaps and islands, sessions) without a whole-series window.

Runs are first built inside time slices, where a slice is a bounded number of
steps. Only the first and the last run of a slice can continue in another one,
so only those - two rows per slice - go through a window over the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timechunks import DAY, fdiv, micros

# how each aggregate of a run is merged when two partial runs are joined
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def find_runs(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    max_gap: int,
    aggs: dict[str, tuple[str, Column]] | None = None,
    chunk: int = 30 * DAY,
) -> DataFrame:
    """One row per maximal run of rows whose successive distance is <= `max_gap` microseconds.

    `aggs` maps an output name to (merge kind, expression); the kind is one of
    sum, min, max. The result has the keys, `run_start`, `run_end`, `n_rows`
    and the aggregates, start and end being timestamps of existing rows.
    """
    aggs = aggs or {}
    slice_keys = [*keys, "_slice"]
    rows = df.withColumn("_us", micros(ts)).withColumn("_slice", fdiv(F.col("_us"), chunk))
    w = Window.partitionBy(*slice_keys).orderBy("_us")
    prev = F.lag("_us").over(w)
    rows = rows.withColumn("_new", (prev.isNull() | (F.col("_us") - prev > max_gap)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = rows.groupBy(*slice_keys, "_run").agg(
        F.min(ts).alias("run_start"),
        F.max(ts).alias("run_end"),
        F.min("_us").alias("_s"),
        F.max("_us").alias("_e"),
        F.count(F.lit(1)).alias("n_rows"),
        *[_MERGE[kind](expr).alias(name) for name, (kind, expr) in aggs.items()],
    )
    ws = Window.partitionBy(*slice_keys)
    local = local.withColumn("_last", F.max("_run").over(ws))
    out = [*keys, "run_start", "run_end", "n_rows", *aggs]
    on_edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_last"))
    inner = local.where(~on_edge).select(*out)
    wk = Window.partitionBy(*keys).orderBy("_s") if keys else Window.partitionBy(F.lit(0)).orderBy("_s")
    before = F.lag("_e").over(wk)
    edge = local.where(on_edge).withColumn(
        "_new", (before.isNull() | (F.col("_s") - before > max_gap)).cast("int")
    )
    edge = edge.withColumn("_run", F.sum("_new").over(wk.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.groupBy(*keys, "_run").agg(
        F.min("run_start").alias("run_start"),
        F.max("run_end").alias("run_end"),
        F.sum("n_rows").alias("n_rows"),
        *[_MERGE[kind](F.col(name)).alias(name) for name, (kind, _) in aggs.items()],
    )
    return inner.unionByName(edge.select(*out))
