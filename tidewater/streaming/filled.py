"""Gaps of many series filled, and the next value forecast, row by row as a stream comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUT = "series string, ts timestamp, value double, forecast double"
SEASON = 7


def filled_batch(rows: DataFrame, season: int = SEASON) -> DataFrame:
    """series, ts, value, forecast of rows (series, ts, value): value with gaps filled from before, forecast the filled value a season of rows earlier. Of rows of one series and time the greatest counts; a missing value is the least."""
    one = rows.filter("series is not null and ts is not null").groupBy("series", F.col("ts").cast("timestamp").alias("ts")).agg(F.max("value").alias("value"))
    w = Window.partitionBy("series").orderBy("ts")
    full = one.withColumn("value", F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return full.select("series", "ts", "value", F.lag("value", season).over(w).alias("forecast"))


class Filler(StatefulProcessor):
    """Of a series it keeps the rows that the watermark has not passed, and the last `season` filled values.

    A timer for the earliest waiting row lets go, in order of time, all that the
    watermark has passed by then; so rows may come in any order within it. A timer
    `idle` after the last row let go takes the state out, and the series begins anew.
    """

    def __init__(self, season: int, idle_ms: int):
        self.season, self.idle_ms = season, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "value double")
        self.recent = handle.getValueState("recent", "at long, values array<double>")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for ts, value in zip(frame["ts"], frame["value"], strict=True):
                at, value = int(ts.value // 1_000_000), None if value != value or value is None else float(value)
                if self.waiting.containsKey((at,)):
                    before = self.waiting.getValue((at,))[0]
                    value = max((x for x in (before, value) if x is not None), default=None)
                self.waiting.updateValue((at,), (value,))
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        upto = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(k[0] for k in self.waiting.keys() if k[0] <= upto)
        last, values = self.recent.get() if self.recent.exists() else (None, [])
        values, out = list(values), []
        for at in due:
            value = self.waiting.getValue((at,))[0]
            if value is None and values:
                value = values[-1]
            out.append((key[0], pd.Timestamp(at, unit="ms"), value, values[-self.season] if len(values) >= self.season else None))
            values = [*values, value][-self.season :]
            self.waiting.removeKey((at,))
            last = at
        if due:
            self.recent.update((last, values))
            self.handle.registerTimer(last + self.idle_ms)
        elif last is not None and upto >= last + self.idle_ms and not any(True for _ in self.waiting.keys()):
            self.recent.clear()
        if out:
            yield pd.DataFrame(out, columns=["series", "ts", "value", "forecast"]).astype({"value": float, "forecast": float})

    def close(self) -> None:
        pass


def filled_stream(rows: DataFrame, late: str = "1 day", season: int = SEASON, idle_days: int = 365) -> DataFrame:
    """filled_batch of a stream: each row once the watermark, `late` behind the latest row, has passed it; rows later than that are dropped.

    Times are taken to the millisecond. State is a season of values and the waiting
    rows of each series, none of a series without rows for idle_days. Needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    timed = rows.filter("series is not null and ts is not null").select("series", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).withWatermark("ts", late)
    return timed.groupBy("series").transformWithStateInPandas(Filler(season, idle_days * 86_400_000), OUT, "append", "EventTime")
