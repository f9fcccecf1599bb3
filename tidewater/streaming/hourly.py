"""Hourly series of an event stream, kept up to date as events come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """series, ts, target, amount: events and their value an hour and event type.

    For a stream, hours are given out once the watermark has passed them, and
    events later than that are dropped; for a batch all hours are given out. Money
    is added up in thousandths, as in the batch series.
    """
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    timed = rows.withWatermark("ts", late) if events.isStreaming else rows
    counts = timed.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("series")).agg(F.count("*").cast("double").alias("target"), (F.sum(F.round(F.col("value") * 1000).cast("long")) / 1000.0).alias("amount"))
    return counts.select("series", F.col("w.start").alias("ts"), "target", "amount")
