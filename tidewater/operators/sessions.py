"""Sessions: a key's events that follow one another within a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, last (event), events, amount (value in thousandths, added up) of each session.

    An event belongs to the session whose last event lies `gap` before it or less,
    and one that comes late may join two sessions. For a batch all sessions are
    given out, for a stream those whose gap the watermark has passed; events later
    than that are dropped. Sessions are merged map-side first, so a busy key's
    events are not shuffled one by one. Rows without a key or time are in none.
    """
    rows = events.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, F.col("ts").cast("timestamp").alias("ts"), "value")
    timed = rows.withWatermark("ts", late) if events.isStreaming else rows
    grouped = timed.groupBy(F.session_window("ts", gap).alias("w"), key)
    out = grouped.agg(F.max("ts").alias("last"), F.count("*").alias("events"), (F.sum(F.round(F.col("value") * 1000).cast("long")) / 1000.0).alias("amount"))
    return out.select(key, F.col("w.start").alias("start"), "last", "events", "amount")
