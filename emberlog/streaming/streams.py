"""Streams of log lines: structuring, counts by time, sessions. Additions to the batch operators, which are the norm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.structuring import parse


def line_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of new text files under path: path and line."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def structured_stream(lines: DataFrame, log_format: str, time_format: str | None = None) -> DataFrame:
    """Entries of lines that fit, with ts if time_format is given (from Date and Time). Without state."""
    rows = parse(lines, log_format).filter("is_valid").drop("is_valid")
    return rows if time_format is None else rows.withColumn("ts", F.try_to_timestamp(F.concat_ws(" ", "Date", "Time"), F.lit(time_format)))


def counts(entries: DataFrame, ts: str, event: str, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event and n for each time window, final once the watermark has passed."""
    grouped = entries.withWatermark(ts, late).groupBy(F.window(ts, window, slide) if slide else F.window(ts, window), event)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), event, "n")


def sessions(entries: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """key, start, end and n for each run of events without a gap."""
    grouped = entries.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
