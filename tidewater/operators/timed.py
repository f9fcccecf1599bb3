"""Joins along an axis of time (or whole numbers): the last row at or before, and intervals that touch.

Both are equi-joins or windows within ranges of the axis: no side is compared
with every row of the other, and a key with most of the rows is still many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.ranges import axis, bounds, range_of, unit

#: Rows of both sides in a range of the as-of join, about.
RANGE_ROWS = 1_000_000
#: Bins of the interval join grow by this many powers of two from level to level.
LEVEL_BITS = 3


def _present(by: Iterable[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).isNotNull()
    return out


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Iterable[str] = (), tolerance: float | None = None, prefix: str = "matched_", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every row of left with the last row of right at or before it, of the same key.

    on is a date, timestamp or integer column of both; tolerance, in days, seconds
    or steps of it, is how far back a match may lie. right's columns but the keys
    come with the prefix, null where there is no match; a null key or place matches
    nothing. Of right rows at one place the greatest, column by column, is taken.

    Both sides are laid together and sorted within key and range of the axis, by
    one shuffle; what a range takes over from those before it is its key's greatest
    row there, from an aggregate of one row a key and range.
    """
    by = list(by)
    here = left.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], axis(left, on).alias("__x"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"))
    kept = right.filter(_present([*by, on]))
    names = [c for c in right.columns if c not in by]
    there = kept.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], axis(right, on).alias("__x"), F.lit(0).alias("__side"), F.struct(axis(right, on).alias("x"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("__right"))
    both = here.unionByName(there, allowMissingColumns=True)
    ends = bounds(here.select("__x").unionByName(there.select("__x")).filter("__x is not null"), range_rows)
    both = both.withColumn("__range", range_of(F.col("__x"), ends))
    keys = [f"__k{i}" for i in range(len(by))] + ["__range"]
    w = Window.partitionBy(*keys).orderBy("__x", "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__right", ignorenulls=True).over(w))
    if ends:
        before = Window.partitionBy(*(keys[:-1] or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        over = both.groupBy(*keys).agg(F.max("__right").alias("__most"))
        over = over.select(*[F.col(k).alias(f"{k}_") for k in keys], F.last("__most", ignorenulls=True).over(before).alias("__over"))
        same = F.lit(True)
        for k in keys:  # null keys match nothing anyway
            same = same & (F.col(k) == F.col(f"{k}_"))
        found = found.filter("__side = 1").join(over, same, "left").withColumn("__found", F.coalesce("__found", "__over"))
    ok = _present(["__x", *keys[:-1]])
    if tolerance is not None:
        ok = ok & (F.col("__x") - F.col("__found.x") <= F.lit(int(tolerance * unit(left, on))))
    return found.filter("__side = 1").select("__left.*", *[F.when(ok, F.col(f"__found.c{i}")).alias(f"{prefix}{c}") for i, c in enumerate(names)])


def _level(length: Column) -> Column:
    """The least level, a multiple of LEVEL_BITS, whose bins are longer than the interval: it touches two of them at most."""
    bits = F.ceil(F.log2(length.cast("double") + 1.0) + F.lit(1e-9))
    return (F.ceil(bits / LEVEL_BITS) * LEVEL_BITS).cast("int")


def _bin(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def _dealt(df: DataFrame, low: str, high: str, by: list[str], side: str) -> DataFrame:
    """Intervals with keys, ends and level; those with a null key or end, or whose end lies before their begin, touch nothing."""
    rows = df.filter(_present([*by, low, high])).select(*[F.col(c).alias(f"k{i}{side}") for i, c in enumerate(by)], axis(df, low).alias(f"low{side}"), axis(df, high).alias(f"high{side}"), F.struct(*df.columns).alias(f"row{side}"))
    return rows.filter(F.col(f"low{side}") <= F.col(f"high{side}")).withColumn(f"level{side}", _level(F.col(f"high{side}") - F.col(f"low{side}")))


def _levels(rows: DataFrame, side: str) -> list[int]:
    return sorted(r[0] for r in rows.select(f"level{side}").distinct().collect())  # 22 at most


def _binned(rows: DataFrame, side: str, other: list[int]) -> DataFrame:
    """A row for each level at which it may meet the other side, and each bin it touches there."""
    own = F.col(f"level{side}")
    levels = F.array_distinct(F.transform(F.array(*[F.lit(x) for x in other]), lambda x: F.greatest(x, own)))
    slots = rows.withColumn("level", F.explode(levels))
    at = F.col("level")
    slots = slots.withColumn("bin", F.explode(F.sequence(_bin(F.col(f"low{side}"), at), _bin(F.col(f"high{side}"), at))))
    return slots.withColumnsRenamed({"level": f"at{side}", "bin": f"bin{side}"})


def overlap_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], by: Iterable[str] = (), prefix: str = "matched_") -> DataFrame:
    """All pairs of rows of one key whose closed intervals share a place; a point is an interval with equal ends.

    Ends are dates, timestamps or integers, alike on both sides. right's columns but
    the keys come with the prefix. Intervals lie in bins of a level that fits their
    length, so that the longest does not spread over many small bins; pairs meet at
    the level of the longer one, in the first bin they share, so that none comes
    twice. The join is one on key, level and bin.
    """
    by = list(by)
    a, b = _dealt(left, *left_ends, by, "_a"), _dealt(right, *right_ends, by, "_b")
    levels_a, levels_b = _levels(a, "_a"), _levels(b, "_b")
    if not levels_a or not levels_b:
        a, b, levels_a, levels_b = a.limit(0), b.limit(0), [0], [0]
    a, b = _binned(a, "_a", levels_b), _binned(b, "_b", levels_a)
    on = (F.col("at_a") == F.col("at_b")) & (F.col("bin_a") == F.col("bin_b"))
    for i in range(len(by)):
        on = on & (F.col(f"k{i}_a") == F.col(f"k{i}_b"))
    first = F.greatest(_bin(F.col("low_a"), F.col("at_a")), _bin(F.col("low_b"), F.col("at_a")))
    on = on & (F.col("low_a") <= F.col("high_b")) & (F.col("low_b") <= F.col("high_a")) & (F.col("at_a") == F.greatest("level_a", "level_b")) & (F.col("bin_a") == first)
    return a.join(b, on).select("row_a.*", *[F.col(f"row_b.{c}").alias(f"{prefix}{c}") for c in right.columns if c not in by])


def range_join(points: DataFrame, intervals: DataFrame, point: str, ends: tuple[str, str], by: Iterable[str] = (), prefix: str = "matched_") -> DataFrame:
    """overlap_join of points: every row of points with every interval of its key that holds it."""
    return overlap_join(points, intervals, (point, point), ends, by, prefix)


def runs_of(df: DataFrame, flag: Column, key: str = "store", date: str = "dt") -> DataFrame:
    """key, first, last, days of each run of consecutive days on which flag holds."""
    rows = df.filter(flag).withColumn("__island", F.date_sub(F.col(date), F.row_number().over(Window.partitionBy(key).orderBy(date))))
    return rows.groupBy(key, "__island").agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count("*").alias("days")).drop("__island")
