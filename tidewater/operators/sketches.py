"""Quantiles and distinct counts from sketches that are kept per period and merged, so that no raw row is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Size of a quantile sketch: exact up to about this many values, else a rank is off by less than RANK_ERROR at K 200, in inverse proportion to K.
K, RANK_ERROR = 4096, 0.0165
#: Bits of a distinct-count sketch; an estimate is off by 1.04 / sqrt(2**BITS) on average, three times that at most in practice.
BITS = 12


def residual_sketches(past: DataFrame, target: str = "sales", key: str = "store", date: str = "dt", season: int = 7, period: str = "month", k: int = K) -> DataFrame:
    """key, period, n, sketch: the seasonal differences of each period as a quantile sketch, to be kept."""
    w = Window.partitionBy(key).orderBy("idx")
    rows = past.select(key, F.date_trunc(period, F.col(date)).cast("date").alias("period"), (F.col(target) - F.lag(target, season).over(w)).alias("d"))
    return rows.filter("d is not null").groupBy(key, "period").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("d", F.lit(k)).alias("sketch"))


def merged_spread(sketches: DataFrame, key: str = "store", levels: tuple[float, float] = (0.1, 0.9), k: int = K) -> DataFrame:
    """key, n, low, high: quantiles of all periods together, from their sketches alone."""
    whole = sketches.groupBy(key).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    quantile = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return whole.select(key, "n", quantile(levels[0]).alias("low"), quantile(levels[1]).alias("high"))


def forecast_from(last: DataFrame, sketches: DataFrame, horizon: int = 30, target: str = "sales", key: str = "store", season: int = 7, k: int = K) -> DataFrame:
    """series_id, step, p10, median, p90 from the last season's rows (key, step from 0, target) and kept sketches."""
    rows = last.join(merged_spread(sketches, key, k=k), key)
    steps = F.explode(F.sequence(F.col("step"), F.lit(horizon - 1), F.lit(season).cast("long")))
    rows = rows.filter(F.col("step") < horizon).select(F.col(key).alias("series_id"), steps.alias("step"), target, "low", "high")
    return rows.select("series_id", "step", F.round(F.col(target) + F.col("low"), 6).alias("p10"), F.round(target, 6).alias("median"), F.round(F.col(target) + F.col("high"), 6).alias("p90"))


def distinct_sketches(df: DataFrame, value: str, by: list[str], bits: int = BITS) -> DataFrame:
    """A distinct-count sketch of a column for each group, to be kept."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(bits)).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by, distinct: estimates for coarser groups, from the sketches alone."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
