"""Export shapes: long rows, one column per station, and the metadata record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_format(features: DataFrame, columns: Sequence[str], key: str = "series_id", ts: str = "ts", target: str = "target", valid: str = "valid", digits: int = 6) -> DataFrame:
    """Formatted timestamp, station, rounded features, rounded target and validity as 0 or 1: the long export."""
    return features.select(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col(key).alias("node_ref"), *[F.round(c, digits).alias(c) for c in columns],
        F.round(target, digits).alias("target_y"), F.col(valid).cast("int").alias("valid"),
    )


def wide_format(grid: DataFrame, stations: Sequence[str], ts: str = "ts", key: str = "series_id", value: str = "value") -> DataFrame:
    """One column per named station; the names are given, so no extra pass collects them."""
    return grid.groupBy(ts).pivot(key, list(stations)).agg(F.first(value, ignorenulls=True))


def coverage_record(grid: DataFrame, ts: str = "ts", key: str = "series_id", value: str = "value") -> DataFrame:
    """Dataset metadata: one row per node with its coverage, period and row count, ready to be written as JSON lines."""
    return grid.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_steps"), F.min(ts).alias("start"), F.max(ts).alias("end"),
        F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"),
    )


def provenance_record(grid: DataFrame, features: Sequence[str], timestep: str, horizon_steps: int, rolling_window: str, gap_fill_steps: int, soil_layers: Sequence[str] = (), rainfall_assignment: str = "nearest_neighbour", ts: str = "ts", key: str = "series_id") -> DataFrame:
    """How a dataset was made, as one row: period, step, sizes, features and the settings behind them.

    Soil moisture counts as active if one of its layers is among the features.
    """
    texts = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return grid.agg(F.min(ts).alias("start_date"), F.max(ts).alias("end_date"), F.count_distinct(ts).alias("n_timesteps"), F.count_distinct(key).alias("n_nodes")).select(
        "start_date", "end_date", F.lit(timestep).alias("timestep"), "n_timesteps", "n_nodes", F.lit(len(features)).alias("n_features"), F.lit(horizon_steps).alias("horizon_steps"),
        F.lit(any(f.startswith(layer) for f in features for layer in soil_layers)).alias("soil_moisture_active"), texts(soil_layers).alias("sm_layers"), F.lit(rolling_window).alias("rolling_window"),
        F.lit(gap_fill_steps).alias("gap_fill_steps"), texts(features).alias("dynamic_features"), F.lit(rainfall_assignment).alias("rainfall_assignment_method"),
    )


def write_blocks(blocks: DataFrame, path: str, separator: str, block: str = "block") -> None:
    """Text files of records between separators, for `read_blocks`."""
    blocks.select(block).write.option("lineSep", separator).text(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write partitioned by low-cardinality columns; `overwrite` replaces only the partitions that `df` has rows of.

    Rebalancing on them keeps one partition value in few files and still splits a value that holds very many rows.
    """
    df.hint("rebalance", *by).write.mode(mode).option("partitionOverwriteMode", "dynamic").format(fmt).partitionBy(*by).save(path)
