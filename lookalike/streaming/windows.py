"""Counts of events in event-time windows, with a bound on how late an event may be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """events: ts and event_type, a stream or a table. Times without a zone are taken as they are in the session's zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def latest_access(touches: DataFrame, ttl: str = "30 days") -> DataFrame:
    """touches: path, at (timestamp). The last access of each path, the state of which a stream keeps for ttl."""
    rows = touches.withWatermark("at", ttl) if touches.isStreaming else touches
    return rows.groupBy("path").agg(F.max("at").alias("last_accessed"))
