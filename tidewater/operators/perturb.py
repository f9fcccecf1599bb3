"""Controlled changes of covariates that stress a forecaster. The target never changes.

Each takes rows with the series key and idx, and gives rows. Random ones are
drawn from a hash of seed, column and place, so reruns and other cluster sizes
give the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.encode import numeric_columns, scrubbed

SEED = 42


def _require(df: DataFrame, *names: str) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


#: A column that, where it is there, holds how many rows the series has; else it is counted.
LENGTH = "__length"


def sized(df: DataFrame, key: str = "store") -> DataFrame:
    """df with LENGTH, so that many perturbations of it count once."""
    return df if LENGTH in df.columns else df.withColumn(LENGTH, F.count("*").over(Window.partitionBy(key)))


def _with_length(df: DataFrame, key: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    out = change(sized(df, key))
    return out if LENGTH in df.columns else out.drop(LENGTH)


def _numbers(df: DataFrame, columns: Iterable[str] | None, key: str, target: str) -> list[str]:
    return list(columns) if columns is not None else numeric_columns(df, (key, "idx", target, LENGTH))


def uniform(name: Column, at: int) -> Column:
    """A number strictly between 0 and 1 from eight hexadecimal digits of the hash of name."""
    return (F.conv(F.substring(F.md5(name), at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(label: str, key: str = "store", seed: int = SEED) -> Column:
    """Standard normal, by Box and Muller, for label, series and place."""
    name = F.concat_ws(":", F.lit(label), F.lit(str(seed)), F.col(key).cast("string"), F.col("idx").cast("string"))
    return F.round(F.sqrt(-2 * F.ln(uniform(name, 1))) * F.cos(2 * F.pi() * uniform(name, 9)), 9)


def noise(df: DataFrame, key: str = "store", seed: int = SEED) -> DataFrame:
    """Adds noise_random, standard normal."""
    return df.withColumn("noise_random", normal("noise", key, seed))


def strong_noise(df: DataFrame, columns: Iterable[str] | None = None, scale: float = 10.0, key: str = "store", target: str = "sales", seed: int = SEED) -> DataFrame:
    """Normal noise times scale on every numeric column but key, idx and target; missing values count as 0."""
    names = _numbers(df, columns, key, target)
    return df.withColumns({c: scrubbed(c) + scale * normal(c, key, seed) for c in names})


def shuffled(df: DataFrame, column: str = "promo", key: str = "store", seed: int = SEED) -> DataFrame:
    """The column's values in another order within each series: the place of a row's hash says whose value it gets."""
    _require(df, column)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("idx").cast("string")))
    place = (F.row_number().over(Window.partitionBy(key).orderBy(order, "idx")) - 1).cast("long")
    dealt = df.select(key, place.alias("idx"), F.col(column).alias("__dealt"))
    return df.join(dealt, [key, "idx"]).withColumn(column, F.col("__dealt")).select(*df.columns)


def missing_future(df: DataFrame, column: str = "school_holiday", horizon: int = 30, key: str = "store") -> DataFrame:
    """The last `horizon` values become 0."""
    _require(df, column)
    return _with_length(df, key, lambda x: x.withColumn(column, F.when(F.col("idx") >= F.col(LENGTH) - horizon, 0).otherwise(F.col(column))))


def time_shift(df: DataFrame, column: str = "promo", shift: int = 7, key: str = "store") -> DataFrame:
    """The column moved on by `shift` places, its end coming round to the start."""
    _require(df, column)
    moved = sized(df, key).select(key, F.pmod(F.col("idx") + shift, F.col(LENGTH)).alias("idx"), F.col(column).alias("__moved"))
    return df.join(moved, [key, "idx"]).withColumn(column, F.col("__moved")).select(*df.columns)


def trend_break(df: DataFrame, magnitude: float = 0.5, start: float = 0.8, columns: tuple[str, ...] = ("promo", "school_holiday"), key: str = "store") -> DataFrame:
    """The first of `columns` there is, times 1 + magnitude, in the last part of the series."""
    found = next((c for c in columns if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {columns} found")
    later = F.col("idx") >= (F.col(LENGTH) * F.lit(float(start))).cast("long")
    return _with_length(df, key, lambda x: x.withColumn(found, F.when(later, F.col(found) * F.lit(1.0 + magnitude)).otherwise(F.col(found).cast("double"))))


def feature_drop(df: DataFrame, columns: tuple[str, ...] = ("promo", "school_holiday")) -> DataFrame:
    return df.drop(*columns)


def partial_mask(df: DataFrame, ratio: float = 0.3, columns: Iterable[str] | None = None, key: str = "store", target: str = "sales") -> DataFrame:
    """Every numeric column but key, idx and target becomes 0 in the last `ratio` of the series (the place as double arithmetic has it)."""
    names = _numbers(df, columns, key, target)
    masked = F.col("idx") >= (F.col(LENGTH) * (F.lit(1.0) - F.lit(float(ratio)))).cast("long")
    return _with_length(df, key, lambda x: x.withColumns({c: F.when(masked, F.lit(0.0)).otherwise(F.col(c).cast("double")) for c in names}))


def scaling(df: DataFrame, scale: float = 2.0, columns: Iterable[str] | None = None, key: str = "store", target: str = "sales") -> DataFrame:
    names = _numbers(df, columns, key, target)
    return df.withColumns({c: F.col(c) * F.lit(float(scale)) for c in names})


def unchanged(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Perturbation:
    """A change, its title in reports, the covariates whose future the forecaster is told, and its horizon."""

    apply: Callable[[DataFrame], DataFrame]
    title: str
    label: str
    known_future: tuple[str, ...] = ()
    horizon: int = 30


#: In the order of the report.
PERTURBATIONS = {
    "noise": Perturbation(noise, "Noise", "Noise"),
    "strong_noise": Perturbation(strong_noise, "Strong Noise", "StrongNoise"),
    "shuffle": Perturbation(shuffled, "Shuffle", "Shuffle", ("promo",)),
    "missing_future": Perturbation(missing_future, "Missing Future", "MissingFuture", ("school_holiday",)),
    "time_shift": Perturbation(time_shift, "Time Shift", "TimeShift", ("promo",)),
    "trend_break": Perturbation(trend_break, "Trend Break", "TrendBreak", ("promo",)),
    "feature_drop": Perturbation(feature_drop, "Feature Drop", "FeatureDrop"),
    "partial_mask": Perturbation(partial_mask, "Partial Mask", "PartialMask"),
    "scaling": Perturbation(scaling, "Scaling", "Scaling"),
    "long_horizon": Perturbation(unchanged, "Long Horizon", "LongHorizon", (), 90),
}
