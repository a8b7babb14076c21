"""Reliable lineage cuts for loops and for values that two branches must share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[tempfile.TemporaryDirectory] = []  # removed when the driver's Python ends


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    Only a local master, whose executors are the driver, may do without: it gets a folder that is removed at the end.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="rivulet-", ignore_cleanup_errors=True))
    return _LOCAL[0].name


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; see `shared_root`."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def cut(df: DataFrame, compact: bool = False) -> DataFrame:
    """Write the rows to the checkpoint folder so that a lost executor costs no recomputation.

    `compact` rebalances first: loops that add a union per round would otherwise
    carry ever more, ever smaller partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df.hint("rebalance") if compact else df).checkpoint(eager=True)
