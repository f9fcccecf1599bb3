"""Calendar and run-length features of dated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_CAP = 30


def with_calendar(df: DataFrame, date: str = "dt") -> DataFrame:
    """year, month, day, day_of_week (Monday 0), week_of_year (ISO), day_of_year, is_weekend; a text date that does not parse raises."""
    d = F.col(date) if dict(df.dtypes)[date] in ("date", "timestamp", "timestamp_ntz") else F.to_date(F.col(date))
    return df.withColumns(
        {
            "year": F.year(d).cast("long"),
            "month": F.month(d).cast("long"),
            "day": F.dayofmonth(d).cast("long"),
            "day_of_week": F.weekday(d).cast("long"),
            "week_of_year": F.weekofyear(d).cast("long"),
            "day_of_year": F.dayofyear(d).cast("long"),
            "is_weekend": (F.weekday(d) >= 5).cast("long"),
        }
    )


def promo_effect(promo: str = "promo", is_open: str = "open") -> Column:
    return F.col(promo) * F.col(is_open)


def closed_run(df: DataFrame, key: str = "store", order: str = "dt", is_open: str = "open", cap: int = RUN_CAP) -> DataFrame:
    """Adds closed_run: how many closed rows in a row end here, 0 where open, at most cap."""
    w = Window.partitionBy(key).orderBy(order)
    island = F.sum((F.col(is_open) == 1).cast("int")).over(w)
    inside = Window.partitionBy(key, "__island").orderBy(order)
    run = F.sum((F.col(is_open) != 1).cast("int")).over(inside)
    return df.withColumn("__island", island).withColumn("closed_run", F.when(F.col(is_open) == 1, 0).otherwise(F.least(run, F.lit(cap))).cast("long")).drop("__island")


def days_to_open(df: DataFrame, key: str = "store", order: str = "dt", is_open: str = "open", cap: int = RUN_CAP) -> DataFrame:
    """Adds days_to_open: days until the next open day, 0 where open, cap where none follows."""
    ahead = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    following = F.last(F.when(F.col(is_open) == 1, F.col(order)), ignorenulls=True).over(ahead)
    return df.withColumn("days_to_open", F.coalesce(F.least(F.datediff(following, F.col(order)), F.lit(cap)), F.lit(cap)).cast("long"))
