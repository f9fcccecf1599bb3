"""Values on a whole-number axis, and the range of it that each falls in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges at most; their bounds go along with every task.
MOST = 4096


def axis(df: DataFrame, name: str) -> Column:
    """A column as whole numbers in its order: days of dates, microseconds of timestamps, integers as they are."""
    kind, column = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):  # no time zone comes in
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    if isinstance(kind, T.IntegralType):
        return column.cast("long")
    raise TypeError(f"{name} is neither a date, a timestamp nor an integer")


def unit(df: DataFrame, name: str) -> int:
    """Steps of the axis in a day (dates), a second (timestamps) or 1 (integers)."""
    return 1_000_000 if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)) else 1


def bounds(values: DataFrame, rows_each: int) -> list[int]:
    """Upper ends of all ranges but the last, ascending, so that each holds about rows_each rows of the one column of values."""
    name = values.columns[0]
    many = min(MOST, values.count() // rows_each + 1)
    if many < 2:
        return []
    ends = values.agg(F.percentile_approx(name, [i / many for i in range(1, many)], 20 * many)).first()[0]
    return sorted(set(ends or []))


def range_of(value: Column, ends: list[int]) -> Column:
    """How many of the ends are below the value, by halving: some twelve steps for all there may be."""
    if not ends:
        return F.lit(0)
    table = F.array(*[F.lit(x).cast("long") for x in ends])
    steps = [1 << i for i in reversed(range(len(ends).bit_length()))]
    step = lambda at, s: F.when(F.get(table, at + s - 1) < value, at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)
