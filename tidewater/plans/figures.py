"""Data of figures: long rows (figure, series, series_id, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import relational
from tidewater.operators.evaluate import TINY_PLOT

KEYS = ("series_id", "step")


def forecast(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "median", "p10", "p90")


def forecast_vs_truth(df: DataFrame, truth: DataFrame) -> DataFrame:
    return relational.by_step(forecast(df), truth, KEYS, strict=False)


def comparison(base: DataFrame, test: DataFrame) -> DataFrame:
    """Medians of two forecasts, their difference and their difference in percent, by step; nothing for unequal lengths."""
    pairs = relational.by_step(base.select(*KEYS, F.col("median").alias("base_median")), test.select(*KEYS, F.col("median").alias("test_median")), KEYS, strict=False)
    d = F.col("test_median") - F.col("base_median")
    return pairs.withColumn("difference", d).withColumn("percent", 100 * d / (F.abs("base_median") + TINY_PLOT))


def uncertainty(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, (F.col("p90") - F.col("p10")).alias("width"))


def case_study(history: DataFrame, forecast_rows: DataFrame, past: int = 60, future: int = 30, key: str = "store", target: str = "sales") -> DataFrame:
    """(series_id, x, series, value): real past and future, and the forecast from the end of the past on; x = past - 1 is the split."""
    real = relational.case_window(history, past, future, key).select(F.col(key).alias("series_id"), "x", F.concat(F.lit("real_"), "segment").alias("series"), F.col(target).cast("double").alias("value"))
    ahead = forecast_rows.filter(F.col("step") < future)
    lines = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("value")) for c in ("median", "p10", "p90")])
    drawn = ahead.select("series_id", (F.col("step") + past).alias("x"), F.explode(lines).alias("l")).select("series_id", "x", "l.*")
    return real.unionByName(drawn)


def all_figures(history: DataFrame, forecasts: DataFrame, truth: DataFrame, base: str = "covariate", key: str = "store", target: str = "sales") -> DataFrame:
    """Every figure's rows in one table: single forecasts, against truth, case studies, comparisons with base, widths."""
    run = lambda r: forecasts.filter(F.col("run") == r).drop("run")
    long = lambda df, figure, names: df.select(F.lit(figure).alias("figure") if isinstance(figure, str) else figure.alias("figure"), F.explode(F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).cast("double").alias("y")) for n in names])).alias("l"), "series_id", F.col("step").alias("x")).select("figure", "l.series", "series_id", "x", "l.y")
    parts = [long(forecasts.filter(F.col("run").isin("univariate", base, "long_horizon")), F.concat(F.lit("forecast_"), "run"), ("median", "p10", "p90"))]
    for r in ("univariate", base):
        parts.append(long(forecast_vs_truth(run(r), truth), f"truth_{r}", ("median", "p10", "p90", "y_true")))
        parts.append(case_study(history, run(r), key=key, target=target).select(F.lit(f"case_{r}").alias("figure"), "series", "series_id", "x", F.col("value").alias("y")))
    others = relational.fan_out(run(base), forecasts.filter(~F.col("run").isin("univariate", base, "long_horizon")))
    d = F.col("median") - F.col("base_median")
    compared = others.withColumns({"difference": d, "percent": 100 * d / (F.abs("base_median") + TINY_PLOT)})
    parts.append(long(compared, F.concat(F.lit("compare_"), "run"), ("base_median", "median", "difference", "percent")))
    parts.append(long(forecasts.filter(F.col("run").isin(base, "missing_future", "scaling")).withColumn("width", F.col("p90") - F.col("p10")), F.concat(F.lit("width_"), "run"), ("width",)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
