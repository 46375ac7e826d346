"""Extensions over streams: nothing here has a counterpart in batch retrieval, but job logs and events arrive as files.

Each function takes a streaming (or static) DataFrame and returns one; starting and stopping queries is the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and means by type in tumbling (or sliding) windows; events later than ``late`` are left out."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def latest_status(log: DataFrame, key: str = "user_id", order: str = "event_id", status: str = "event_type") -> DataFrame:
    """The latest status of each job of a log that keeps coming."""
    return log.groupBy(key).agg(F.max_by(status, order).alias("status"), F.max(order).alias(order))
