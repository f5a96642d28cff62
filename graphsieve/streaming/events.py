"""An extension, not parity: a user graph kept up from a stream of events with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slots(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Distinct (slot, event_type, user_id) of a stream with ts, event_type and user_id; late rows beyond ``late`` are not counted."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 600) * 600)
    return timed.withWatermark("ts", late).withColumn("slot", slot).dropDuplicatesWithinWatermark(["slot", "event_type", "user_id"]).select("slot", "event_type", "user_id")


def activity(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """window, event_type, n and users (approximate) per tumbling window."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
