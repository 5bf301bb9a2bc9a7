"""Windows over events: each function takes a static or a streaming DataFrame, and the sinks that make them incremental."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def late(rows: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A watermark where the rows are a stream."""
    return rows.withWatermark(ts, delay) if rows.isStreaming else rows


def tumbling(rows: DataFrame, size: str) -> DataFrame:
    """(event_type, start, n, total) of windows side by side."""
    grouped = late(rows).groupBy("event_type", F.window("ts", size)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select("event_type", F.col("window.start").alias("start"), "n", "total")


def sliding(rows: DataFrame, size: str, step: str) -> DataFrame:
    """(event_type, start, n) of overlapping windows."""
    return late(rows).groupBy("event_type", F.window("ts", size, step)).agg(F.count("*").alias("n")).select("event_type", F.col("window.start").alias("start"), "n")


def sessions(rows: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, n) of runs of events closer than ``gap``."""
    return late(rows).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def first_seen(rows: DataFrame) -> DataFrame:
    """(user_id, event_type, first_ts, n)."""
    return late(rows).groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))


def as_of(rows: DataFrame, asked: str, looked: str) -> DataFrame:
    """For each ``asked`` event the user's latest ``looked`` event at or before it: one window, no pairs."""
    both = rows.where(F.col("event_type").isin(asked, looked)).withColumn("side", (F.col("event_type") == asked).cast("int"))
    w = Window.partitionBy("user_id").orderBy("ts", "side", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.col("event_id")), ignorenulls=True).over(w)
    return both.withColumn("before_id", last).where("side = 1").select("event_id", "before_id")


def dedup(rows: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """First of each key, within the watermark where the rows are a stream."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def ingest(spark: SparkSession, source: str, schema: str, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """New Parquet files of a folder, each micro-batch handed to ``merge``; resumes from ``checkpoint``, stops when done."""
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
