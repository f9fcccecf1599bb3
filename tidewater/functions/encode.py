"""Numbers from texts and from numbers that are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.plans.settle import settled

FLOAT_MAX = 3.4028234663852886e38


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    """Numbers and booleans by schema, sorted by name."""
    return sorted(f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in without)


def _codes(values: DataFrame) -> DataFrame:
    """column, value, code: the 0-based rank of each value among those of its column.

    Values are dealt to ranges, ranked within them and moved on by what the ranges
    before hold, so no task sees a whole dictionary.
    """
    dealt = settled(values.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("column", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))  # one row a range and column
    place = F.row_number().over(Window.partitionBy("column", "part").orderBy("value")) - 1
    return dealt.withColumn("place", place).join(starts, ["column", "part"]).select("column", "value", (F.col("start") + F.col("place")).cast("long").alias("code"))


def ordinal(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each text column becomes the 0-based rank of its value in code point order; null becomes -1.

    The distinct values of all columns are found in one pass; whether a dictionary is
    sent to all executors is left to its size as written.
    """
    names = text_columns(df) if columns is None else columns
    if not names:
        return df
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names])).alias("x")
    codes = settled(_codes(df.select(pairs).select("x.*").filter("value is not null").distinct()))
    order = df.columns
    for c in names:
        known = codes.filter(F.col("column") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        df = df.join(known, df[c] == F.col("__value"), "left").withColumn(c, F.coalesce("__code", F.lit(-1).cast("long"))).select(*order)
    return df


def coerced(c: str | Column) -> Column:
    """A text as a number, 0 where it is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def as_float32(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("float")


def scrubbed(c: str | Column) -> Column:
    """Missing and not-a-number become 0, infinities the largest 32-bit floats."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(c.isNull() | F.isnan(c), 0.0).when(c == float("inf"), FLOAT_MAX).when(c == float("-inf"), -FLOAT_MAX).otherwise(c)


def four_places(c: str | Column) -> Column:
    return F.format_string("%.4f", c)
