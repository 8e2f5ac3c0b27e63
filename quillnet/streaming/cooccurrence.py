"""An extension: users who meet within an hour, counted over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_users(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, users, events) of each event-time hour. On a table users are counted exactly, on a stream approximately."""
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.count_distinct("user_id")
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(users.alias("users"), F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("hour"), "users", "events")
    )
