"""Event-time windows over an event table, and their rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECONDS = "yyyy-MM-dd HH:mm:ss"


def anchored(events: DataFrame) -> DataFrame:
    """Events by day windows that begin at 22:00, and type."""
    w = F.window("ts", "24 hours", "24 hours", "22 hours")
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.date_format("w.start", SECONDS).alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame) -> DataFrame:
    """Events by six-hour windows that begin every two hours."""
    w = F.window("ts", "6 hours", "2 hours")
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", SECONDS).alias("start"), "n")


def over_limit(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Events with more than the limit of their user's events in the seconds up to them."""
    w = Window.partitionBy("user_id").orderBy(F.unix_seconds("ts")).rangeBetween(-seconds, 0)
    return events.withColumn("n", F.count("*").over(w)).where(F.col("n") > limit).select("event_id", "user_id", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user that end after a gap."""
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.date_format("w.start", SECONDS).alias("start"), "n")
