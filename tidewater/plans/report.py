"""The text report of all comparisons, as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import evaluate, relational
from tidewater.operators.perturb import PERTURBATIONS

TITLE = "=== FORECAST COMPARISON REPORT ==="
LONG_TEXT = ("90 steps from the same origin and the same past, without covariates.", "Mean of p90 - p10 over all series and steps:")


def _section(df: DataFrame, layout: dict[str, tuple[int, str, list[tuple[str, str]]]]) -> DataFrame:
    """Lines of sections from rows of metrics, one a run: order, title and (name, column) by run; a run without a row has no lines."""
    parts = F.array()
    for run, (order, title, pairs) in layout.items():
        lines = [F.lit(f"> {title}"), *[F.concat(F.lit(f"{name}: "), F.format_string("%.4f", c)) for name, c in pairs], F.lit("")]
        items = F.array(*[F.struct(F.lit(order * 100 + i).cast("long").alias("line_no"), x.alias("line")) for i, x in enumerate(lines)])
        parts = F.when(F.col("run") == run, items) if run == next(iter(layout)) else parts.when(F.col("run") == run, items)
    return df.select(F.explode(parts).alias("x")).select("x.*")


def _numbered(df: DataFrame, order: int, lines: list) -> DataFrame:
    items = F.array(*[F.struct(F.lit(order * 100 + i).cast("long").alias("line_no"), x.alias("line")) for i, x in enumerate(lines)])
    return df.select(F.explode(items).alias("x")).select("x.*")


def build(spark, forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    """line_no, line. forecasts: run, series_id, step, p10, median, p90; runs that are missing leave their sections out.

    The number of sections is fixed, so what is joined and sorted here is a
    handful of aggregate rows; forecasts themselves are read by grouped aggregates.
    """
    if truth is None:
        raise ValueError("the report needs the true values")
    names = {"MAE": "mae", "RMSE": "rmse", "PercentDifference": "percent_difference"}
    of = lambda run: forecasts.filter(F.col("run") == run)
    head = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("line_no"), F.lit(x).alias("line")) for i, x in enumerate((TITLE, ""))])).alias("x")).select("x.*")
    parts = [head]
    five = lambda base, test: [*names.items(), (f"Interval_{base}", "interval_base"), (f"Interval_{test}", "interval_test")]
    first = evaluate.compare(relational.fan_out(of("univariate"), of("covariate")), ["run"])
    parts.append(_section(first, {"covariate": (1, "Covariates vs Univariate", five("Univariate", "Covariates"))}))
    scored = forecasts.filter(F.col("run").isin("univariate", "covariate")).join(truth, ["series_id", "step"]).groupBy("run").agg(evaluate.wql().alias("wql"))
    labels = {"univariate": "Univariate", "covariate": "Covariates"}
    parts.append(_section(scored, {run: (order, f"{label} vs Ground Truth", [("WQL", "wql")]) for order, (run, label) in enumerate(labels.items(), 2)}))
    tests = {run: p for run, p in PERTURBATIONS.items() if run != "long_horizon"}
    compared = evaluate.compare(relational.fan_out(of("covariate"), forecasts.filter(F.col("run").isin(*tests))), ["run"])
    parts.append(_section(compared, {run: (order, f"{p.title} vs Covariates", five("Covariates", p.label)) for order, (run, p) in enumerate(tests.items(), 4)}))
    width = of("long_horizon").groupBy("run").agg(evaluate.interval_width(F.col("p10"), F.col("p90")).alias("width"))
    lines = [F.lit("> Long Horizon Test"), *[F.lit(x) for x in LONG_TEXT], F.concat(F.lit("Average prediction interval width: "), F.format_string("%.4f", "width"))]
    parts.append(_numbered(width, 4 + len(tests), lines))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
