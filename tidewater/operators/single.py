"""A table as one series of any length.

Without a key no window may span the rows, as one task would get them all. Rows
are dealt to ranges of their order, sorted and numbered within each, and written
once. What a range must know of those before it (how many rows, the last value of
each column) is one small row a range, which the driver adds up; only that goes
back to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.perturb import LENGTH, SEED
from tidewater.plans.settle import settled

PART, AT, BEGIN = "__part", "__at", "__begin"
#: monotonically_increasing_id numbers the rows of a partition in its low bits.
ROW_BITS = (1 << 33) - 1


@dataclass(frozen=True)
class Placed:
    """Rows with the range they are in and their place in it; rows of each range in order, ranges ascending."""

    rows: DataFrame
    columns: tuple[str, ...]
    sizes: tuple[tuple[int, int], ...]

    @property
    def length(self) -> int:
        return sum(n for _, n in self.sizes)

    def with_ranges(self, schema: str, values: Iterable[tuple]) -> DataFrame:
        """Rows joined with one row a range (range, first place, values)."""
        begin, known = 0, []
        for (part, n), more in zip(self.sizes, values, strict=True):
            known.append((part, begin, *more))
            begin += n
        small = self.rows.sparkSession.createDataFrame(known, ", ".join(x for x in (f"{PART} int, {BEGIN} long", schema) if x))
        return self.rows.join(F.broadcast(small), PART)  # as many rows as ranges

    def indexed(self) -> DataFrame:
        """All columns and idx, the 0-based place in the whole series."""
        out = self.with_ranges("", [()] * len(self.sizes))
        return out.select(*[c for c in self.columns if c != "idx"], (F.col(BEGIN) + F.col(AT)).alias("idx"))

    def sized(self) -> DataFrame:
        """indexed, with the length that perturbations look for, so that none of them counts."""
        return self.indexed().withColumn(LENGTH, F.lit(self.length))


def place(df: DataFrame, order: str | Column | Iterable, parts: int | None = None) -> Placed:
    """df in the given order (columns that together tell rows apart; equal rows stand in any order), dealt to `parts` ranges or as many as the session shuffles to."""
    by = [order] if isinstance(order, str | Column) else list(order)
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    numbered = ranged.sortWithinPartitions(*by).withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))})
    rows = settled(numbered)
    sizes = sorted((r[PART], r["count"]) for r in rows.groupBy(PART).count().collect())  # one row a range
    return Placed(rows, tuple(df.columns), tuple(sizes))


def filled(placed: Placed, columns: Iterable[str], backward: bool = False) -> DataFrame:
    """The last value before a gap, from earlier ranges too; if backward, the series' first value where there is none before. With idx."""
    names = [c for c in placed.columns if c in set(columns)]
    there = lambda c: F.when(F.col(c).isNotNull(), F.col(AT))
    ends = placed.rows.groupBy(PART).agg(*[F.max_by(c, there(c)).alias(f"last_{i}") for i, c in enumerate(names)], *[F.min_by(c, there(c)).alias(f"first_{i}") for i, c in enumerate(names)])
    known = {r[PART]: r for r in ends.collect()}  # one row a range
    carried, before, first = [], [None] * len(names), [None] * len(names)
    for part, _ in placed.sizes:
        carried.append(list(before))
        for i in range(len(names)):
            before[i] = before[i] if known[part][f"last_{i}"] is None else known[part][f"last_{i}"]
            first[i] = known[part][f"first_{i}"] if first[i] is None else first[i]
    rows = [[v if v is not None or not backward else first[i] for i, v in enumerate(x)] for x in carried]
    kinds = {f.name: f.dataType.simpleString() for f in placed.rows.schema}
    out = placed.with_ranges(", ".join(f"__carried_{i} {kinds[c]}" for i, c in enumerate(names)), rows)
    own = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    value = {c: F.coalesce(F.last(c, ignorenulls=True).over(own), F.col(f"__carried_{i}")) for i, c in enumerate(names)}
    return out.select(*[value.get(c, F.col(c)).alias(c) for c in placed.columns if c != "idx"], (F.col(BEGIN) + F.col(AT)).alias("idx"))


def split(placed: Placed, test_size: int = 30) -> tuple[DataFrame, DataFrame]:
    """(past, test): all but the last test_size rows, and those, both with idx from 0. A series of test_size rows or fewer raises at once."""
    if placed.length <= test_size:
        raise ValueError("Dataset too small for temporal split")
    rows, past = placed.indexed(), placed.length - test_size
    return rows.filter(F.col("idx") < past), rows.filter(F.col("idx") >= past).withColumn("idx", F.col("idx") - past)


def _with_value_of(placed: Placed, other: DataFrame, column: str) -> DataFrame:
    """Indexed rows whose column comes from the row of `other` (idx, __value) at their place."""
    return placed.indexed().join(other, "idx").withColumn(column, F.col("__value")).select(*[c for c in placed.columns if c != "idx"], "idx")


def time_shift(placed: Placed, column: str = "promo", shift: int = 7) -> DataFrame:
    """The column moved on by `shift` places, its end coming round to the start."""
    moved = placed.indexed().select(F.pmod(F.col("idx") + shift, F.lit(placed.length)).alias("idx"), F.col(column).alias("__value"))
    return _with_value_of(placed, moved, column)


def shuffled(placed: Placed, column: str = "promo", seed: int = SEED) -> DataFrame:
    """The column's values in another order: the place of a row's hash says whose value it gets."""
    hashed = placed.indexed().select(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("idx").cast("string"))).alias("__hash"), F.col("idx").alias("__from"), F.col(column).alias("__value"))
    dealt = place(hashed, ["__hash", "__from"]).indexed().select("idx", "__value")
    return _with_value_of(placed, dealt, column)
