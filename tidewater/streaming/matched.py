"""Forecasts met by what really happened, as both come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(forecasts: DataFrame, truths: DataFrame, late_forecasts: str = "2 days", late_truths: str = "2 days", horizon: str = "90 days") -> DataFrame:
    """series_id, ts, issued, p10, median, p90, y_true: every forecast (series_id, issued, ts, p10, median, p90) whose time the truth (series_id, ts, y_true) has come for.

    A forecast is for a time within `horizon` after it was issued. As a stream, each
    side waits for the other as long as that time bound and both watermarks leave
    room for a match, and is forgotten then. Rows without a key or time meet nothing.
    """
    f = forecasts.select("series_id", F.col("issued").cast("timestamp").alias("issued"), F.col("ts").cast("timestamp").alias("ts"), "p10", "median", "p90")
    t = truths.select(F.col("series_id").alias("__id"), F.col("ts").cast("timestamp").alias("__ts"), "y_true")
    if forecasts.isStreaming:
        f = f.withWatermark("issued", late_forecasts)
    if truths.isStreaming:
        t = t.withWatermark("__ts", late_truths)
    bound = F.expr(f"__ts >= issued AND __ts <= issued + INTERVAL {horizon}")
    return f.join(t, (F.col("series_id") == F.col("__id")) & (F.col("ts") == F.col("__ts")) & bound).select("series_id", "ts", "issued", "p10", "median", "p90", "y_true")


def write_once(path: str):
    """For foreachBatch: each micro-batch has a folder named by its number and replaces it, so a batch that is run again adds no rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
