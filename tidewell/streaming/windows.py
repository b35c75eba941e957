"""Event-time windows that run on a batch table or on a stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", delay: str = "10 minutes") -> DataFrame:
    """(window_start, kind, n, total) per hour; on a stream rows later than ``delay`` are dropped and windows close."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__t", delay)
    found = timed.groupBy(F.window("__t", "1 hour").alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.unix_micros("w.start").alias("window_start"), kind, "n", "total")


def late_tolerant_totals(events: DataFrame, *, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(key, session_start, n): sessions that end after ``gap`` without an event."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__t", delay)
    found = timed.groupBy(F.session_window("__t", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.unix_micros("w.start").alias("session_start"), "n")
