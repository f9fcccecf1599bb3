"""Hours and days by the clock of a time zone, over changes of that clock.

Instants are timestamps without a zone that count as UTC, so the session's zone has no
effect. A local day begins at its first instant and has 23, 24 or 25 hours (or a part of one
more, where a zone moves its clock by less); its hours are counted from its beginning, so the
hour that the clock shows twice is two hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local(instant: str | Column, zone: str) -> Column:
    """What the zone's clock shows at an instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(instant).cast("timestamp_ntz") if isinstance(instant, str) else instant)


def day_start(day: Column, zone: str) -> Column:
    """The first instant of a local day."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))


def _hours_between(first: Column, last: Column) -> Column:
    return F.timestamp_diff("SECOND", first, last) / 3600


def with_local_hour(df: DataFrame, zone: str, ts: str = "ts") -> DataFrame:
    """Adds day (local) and hour (how many whole hours of that day had passed). A null instant has neither."""
    out = df.withColumn("day", F.to_date(local(ts, zone)))
    return out.withColumn("hour", F.floor(_hours_between(day_start(F.col("day"), zone), F.col(ts).cast("timestamp_ntz"))).cast("long"))


def local_hours(df: DataFrame, zone: str, key: str) -> DataFrame:
    """Every hour of every local day from the first to the last day of each series, joined with its rows.

    df has key, day and hour (see with_local_hour), one row each at most; rows without
    a day are left out. Adds hours, the length of the day, and is_gap, 1 where df had no row. Days are
    dealt by series and hours made from them, so a long series takes many tasks.
    """
    span = df.groupBy(key).agg(F.min("day").alias("__a"), F.max("day").alias("__b"))
    days = span.select(key, F.explode(F.sequence("__a", "__b")).alias("day"))
    length = _hours_between(day_start(F.col("day"), zone), day_start(F.date_add("day", 1), zone))
    every = days.withColumn("hours", length).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil("hours").cast("long") - 1)).alias("hour"))
    joined = every.join(df.withColumn("__there", F.lit(1)), [key, "day", "hour"], "left")
    return joined.withColumn("is_gap", F.when(F.col("__there").isNull(), 1).otherwise(0).cast("long")).drop("__there")
