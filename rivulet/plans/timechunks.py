"""Windows over time that never need a whole series in one task.

A frame of bounded reach (seven days back, four steps ahead) can be computed
inside a slice of the series as long as the slice also holds the rows its
frames reach into. Each row is copied to every slice that needs it, the window
is partitioned by (keys, slice), and only the rows a slice owns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
STEP = 15 * MINUTE


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (session zone UTC)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def fdiv(a: Column, b: int) -> Column:
    """Floor division that stays integral."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def over_time(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    chunk: int | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most `before`/`after` microseconds.

    The window handed to `cols` is ordered by `_us` (epoch microseconds), so
    both row frames and range frames in microseconds can be built from it.
    """
    rows = df.withColumn("_us", micros(ts))
    return over_axis(rows, keys, "_us", cols, before, after, chunk or 30 * DAY).drop("_us")


def over_axis(
    df: DataFrame,
    keys: Sequence[str],
    axis: str,
    cols: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    chunk: int = 4096,
) -> DataFrame:
    """The same for any integer axis, such as the columns of a raster row."""
    size = max(chunk, before, after, 1)
    at = F.col(axis).cast("long")
    copies = df.withColumn("_slice", F.explode(F.sequence(fdiv(at - after, size), fdiv(at + before, size))))
    w = Window.partitionBy(*keys, "_slice").orderBy(axis)
    return copies.withColumns(cols(w)).where(F.col("_slice") == fdiv(at, size)).drop("_slice")
