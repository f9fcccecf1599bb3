"""Scores of forecasts: one grouped aggregate for all runs and series at once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = (("p10", 0.1), ("median", 0.5), ("p90", 0.9))
TINY, TINY_PLOT = 1e-9, 1e-6


def pinball(y: Column, forecast: Column, q: float) -> Column:
    d = y - forecast
    return F.greatest(F.lit(q) * d, (F.lit(q) - 1) * d)


def wql(y: str = "y_true", quantiles=QUANTILES) -> Column:
    """Weighted quantile loss, an aggregate."""
    loss = sum((pinball(F.col(y), F.col(c), q) for c, q in quantiles), F.lit(0.0))
    return 2 * F.sum(loss) / (F.sum(F.abs(F.col(y))) + TINY) / len(quantiles)


def mae(a: Column, b: Column) -> Column:
    return F.avg(F.abs(a - b))


def mse(a: Column, b: Column) -> Column:
    return F.avg((a - b) * (a - b))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(mse(a, b))


def interval_width(low: Column, high: Column) -> Column:
    return F.avg(high - low)


def percent_difference(base: Column, test: Column) -> Column:
    return 100 * F.avg((test - base) / (F.abs(base) + TINY))


def compare(pairs: DataFrame, by: Iterable[str] = ("run", "series_id")) -> DataFrame:
    """Five metrics of rows with p10, median, p90 and base_p10, base_median, base_p90, per group."""
    base, test = F.col("base_median"), F.col("median")
    return pairs.groupBy(*by).agg(
        mae(base, test).alias("mae"),
        rmse(base, test).alias("rmse"),
        percent_difference(base, test).alias("percent_difference"),
        interval_width(F.col("base_p10"), F.col("base_p90")).alias("interval_base"),
        interval_width(F.col("p10"), F.col("p90")).alias("interval_test"),
    )


def score_levels(rows: DataFrame, levels: Iterable[Iterable[str]]) -> DataFrame:
    """WQL, MAE and number of steps at several levels of detail at once: one expansion and one aggregate for all.

    levels: sets of columns to group by, () for the total. Columns that a level does
    not group by are null there; grouping_id tells such nulls from those in the data.
    """
    levels = [list(x) for x in levels]
    names = list(dict.fromkeys(c for x in levels for c in x))
    out = rows.groupingSets([[F.col(c) for c in x] for x in levels], *names)
    return out.agg(F.grouping_id().alias("grouping_id"), F.count("*").alias("steps"), wql().alias("wql"), mae(F.col("y_true"), F.col("median")).alias("mae"))


def as_rows(metrics: DataFrame, by: Iterable[str], names: Iterable[str]) -> DataFrame:
    """Wide metrics as (…, ord, metric, value)."""
    items = F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(n).alias("metric"), F.col(n).alias("value")) for i, n in enumerate(names)])
    return metrics.select(*by, F.explode(items).alias("x")).select(*by, "x.*")


def mae_by_state(rows: DataFrame, flag: str = "open", by: Iterable[str] = ("series_id",)) -> DataFrame:
    """MAE of median against y_true over all, open and closed steps."""
    error = F.abs(F.col("median") - F.col("y_true"))
    return rows.groupBy(*by).agg(F.avg(error).alias("mae_all"), F.avg(F.when(F.col(flag) == 1, error)).alias("mae_open"), F.avg(F.when(F.col(flag) == 0, error)).alias("mae_closed"))


def wql_summary(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by context: series, mean and median WQL; the best context: least mean to six places, ties to the shorter one) of rows context_len, series_id, wql."""
    summary = rows.groupBy("context_len").agg(F.count("*").alias("series"), F.avg("wql").alias("mean_wql"), F.percentile("wql", 0.5).alias("median_wql"))
    best = summary.orderBy(F.round("mean_wql", 6), "context_len").limit(1)
    return summary, best
