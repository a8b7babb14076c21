"""Following reading files as they arrive: each file once, late rows up to a watermark, tables that can be read at any time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.sources import ingest

#: How late a reading may come after the latest one before it is left out of open slots.
LATE = "7 days"


def reading_stream(spark: SparkSession, path: str, kind: str, station: Column | None = None, late: str = LATE) -> DataFrame:
    """Readings of the text files below a folder, present and future ones, a (series, time, value, quality) row once within the watermark."""
    lines = spark.readStream.schema("value string").option("recursiveFileLookup", "true").text(path).select("value", F.input_file_name().alias("path"))
    rows = ingest.parse_readings(lines, kind, station).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["series_id", "ts", "value", "quality_code"])


def slot_stream(readings: DataFrame, freq: str = "15 minutes") -> DataFrame:
    """Mean, sum and count of each series and slot; a slot is given out once the watermark of the readings has passed it."""
    slots = readings.groupBy("series_id", F.window("ts", freq).alias("w"))
    return slots.agg(F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count("value").alias("n")).select("series_id", F.col("w.start").alias("ts"), "mean", "total", "n")


def catch_up(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append all that has arrived to a Parquet table, and stop. Called again, it goes on after the files and rows that it has seen.

    Progress and state lie in the checkpoint folder, which driver and executors must share; a run that dies is repeated from there and the
    table's own log keeps each batch once.
    """
    stream.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
