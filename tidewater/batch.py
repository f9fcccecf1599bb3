"""The whole batch as one command: raw CSV files to processed series, truth, forecasts, report and figure data.

    python -m tidewater.batch --facts train.csv --dimension store.csv --out folder
    python -m tidewater.batch evaluate --out folder
    python -m tidewater.batch figures --out folder

The last two work on the forecasts that are there, from an earlier batch or (evaluate) a tree of CSV files.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import calendar
from tidewater.functions.encode import numeric_columns, ordinal
from tidewater.operators import evaluate, forecast, perturb, relational
from tidewater.plans import figures, report, runs
from tidewater.plans.settle import clearing, settled
from tidewater.sources import files, series

#: Columns of the fact table and what they are called here.
NAMES = {"Store": "store", "Date": "dt", "Sales": "sales", "Open": "open", "Promo": "promo", "SchoolHoliday": "school_holiday", "StateHoliday": "state_holiday", "Customers": "customers"}
RUNS = ("univariate", "covariate", *perturb.PERTURBATIONS)
#: What daily series have besides, known ahead.
DAILY = ("promo_effect", "closed_run", "days_to_open")
GATED = "covariate_gated"


def joined(spark: SparkSession, facts: str, dimension: str) -> DataFrame:
    """The two files joined, with this library's names."""
    dim = spark.read.option("header", True).option("inferSchema", True).csv(dimension)
    df = relational.left_join(files.read_csv(spark, facts, files.FACT), dim, "Store")
    return df.withColumnsRenamed(NAMES).withColumn("dt", F.to_date("dt"))


def prepared(spark: SparkSession, facts: str, dimension: str) -> DataFrame:
    """Open days with sales, gaps filled, with calendar features and codes for texts; idx counts each series' rows. Columns that are null throughout become 0."""
    return series.indexed(relational.fill_zero(ordinal(calendar.with_calendar(relational.clean(joined(spark, facts, dimension))))))


def prepared_daily(spark: SparkSession, facts: str, dimension: str, **limits) -> DataFrame:
    """Every day of the series that are valid, closed ones too, with run lengths and gated promotion; idx counts days.

    limits are those of relational.validity, which is asked before days are added. Sales
    are not filled: days without a row have none, and count as closed. Other columns
    take the last value before a gap.
    """
    rows = settled(joined(spark, facts, dimension))
    days = relational.reindexed(relational.only_valid(rows, relational.validity(rows, **limits)))
    days = days.withColumn("open", F.when(F.col("is_gap") == 1, 0).otherwise(F.coalesce("open", F.lit(0))).cast("long"))
    days = relational.fill_both(days, columns=[c for c in days.columns if c not in ("store", "dt", "sales", "open", "is_gap")])
    days = calendar.days_to_open(calendar.closed_run(days)).withColumn("promo_effect", calendar.promo_effect())
    days = ordinal(calendar.with_calendar(days))
    return series.indexed(relational.fill_zero(days, [c for c in numeric_columns(days) if c != "sales"]))


def missing_runs(spark: SparkSession, path: str) -> list[str]:
    """The runs that have no forecast under `path` yet, in order; there are a dozen names at most."""
    wanted = spark.createDataFrame([(r,) for r in RUNS], "run string")
    try:
        there = files.read_forecasts(spark, path)
    except AnalysisException:
        return list(RUNS)
    left = {r.run for r in files.not_yet_written(wanted, there, ["run"]).collect()}
    return [r for r in RUNS if r in left]


def _there(spark: SparkSession, path: str) -> DataFrame:
    """A table of an earlier batch; one that is missing or empty is an error."""
    df = files.read_optional(spark, path, fmt="parquet")
    if df is None:
        raise ValueError(f"nothing to read in {path}")
    return df


@clearing
def evaluation(spark: SparkSession, out: str, csv: str | None = None) -> None:
    """Writes report and scores under `out` from the forecasts and the truth that are there, or from a tree of CSV files.

    Of a tree only the files outside ctx_<length> folders are compared; report sections of runs that are missing are left out.
    """
    if csv:
        names = [*RUNS, GATED]
        forecasts = settled(files.read_forecast_files(spark, csv, *names).filter("context_len is null").drop("context_len"))
        truth = settled(files.read_truth_files(spark, csv).filter("context_len is null").drop("context_len"))
        if truth.isEmpty():
            raise ValueError(f"no true values in {csv}")
    else:
        forecasts, truth = _there(spark, f"{out}/forecasts"), _there(spark, f"{out}/ground_truth")
    files.write_report(report.build(spark, forecasts, truth), f"{out}/report")
    scores = forecasts.join(truth, ["series_id", "step"]).groupBy("run", "series_id").agg(evaluate.wql().alias("wql"), evaluate.mae(F.col("y_true"), F.col("median")).alias("mae"))
    scores.write.mode("overwrite").parquet(f"{out}/scores")


@clearing
def drawn(spark: SparkSession, out: str) -> None:
    """Writes figures (a folder a figure) and plot_selection under `out` from what is there."""
    rows, forecasts, truth = (_there(spark, f"{out}/{name}") for name in ("processed", "forecasts", "ground_truth"))
    figures.all_figures(rows, forecasts, truth).write.mode("overwrite").partitionBy("figure").parquet(f"{out}/figures")
    scored = forecasts.filter("run = 'univariate'").join(truth, ["series_id", "step"]).groupBy("series_id").agg(evaluate.mae(F.col("y_true"), F.col("median")).alias("mae"))
    relational.selection(settled(scored), "mae", "series_id").write.mode("overwrite").option("header", True).csv(f"{out}/plot_selection")


def ablation(rows: DataFrame, truth: DataFrame, out: str, lengths: tuple[int, ...], test_size: int, model: Callable[[], Callable] | None) -> None:
    """Writes context_forecasts (folders by length), context_scores (a row a series and length, with is_outlier) and best_context, the lengths by mean score without outliers."""
    past = relational.split(rows, test_size)[0]
    files.write_forecasts(runs.context_forecasts(past, lengths, test_size, model), f"{out}/context_forecasts", "context_len")
    made = files.read_forecasts(rows.sparkSession, f"{out}/context_forecasts").withColumn("context_len", F.col("context_len").cast("long"))
    scores = made.join(truth, ["series_id", "step"]).groupBy("context_len", "series_id").agg(evaluate.wql().alias("wql"))
    relational.outliers(scores, by=["context_len"]).write.mode("overwrite").parquet(f"{out}/context_scores")
    kept = rows.sparkSession.read.parquet(f"{out}/context_scores")
    ranked = kept.groupBy("context_len").agg(F.count("*").alias("series"), F.avg("wql").alias("mean_wql_all"), F.avg(F.when(F.col("is_outlier") == 0, F.col("wql"))).alias("mean_wql"))
    ranked.orderBy(F.round("mean_wql", 6), "context_len").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/best_context")  # a row a length


@clearing
def run(
    spark: SparkSession,
    facts: str,
    dimension: str,
    out: str,
    test_size: int = runs.TEST_SIZE,
    shortest: int = runs.SHORTEST,
    skip_existing: bool = False,
    origin: str = "split",
    model: Callable[[], Callable] | None = None,
    daily: bool = False,
    contexts: tuple[int, ...] = (),
) -> None:
    """Writes processed, ground_truth, forecasts (a folder a run), report, scores, figures (a folder a figure) and plot_selection under `out`.

    Series of `shortest` rows or fewer are left out; if none is left, that is an error. With skip_existing, runs whose
    forecasts are there are not computed again. model is a loader for forecast.hosted. With daily, series
    have all their days (see prepared_daily), a missing sale counts as 0 in what a model is given
    and as nothing in scores, forecasts times the open flag are one run more, and mae_open_closed holds errors by that
    flag. With contexts, the past is cut to each of these lengths besides (see ablation).
    """
    cleaned = prepared_daily(spark, facts, dimension) if daily else prepared(spark, facts, dimension)
    if not files.write_processed(relational.long_enough(cleaned, shortest), f"{out}/processed"):
        raise ValueError(f"no series of more than {shortest} rows")
    rows = files.read_processed(spark, f"{out}/processed")
    test = relational.split(rows, test_size)[1]
    files.write_truth(runs.truth(test), f"{out}/ground_truth", "y_true")
    truth = spark.read.parquet(f"{out}/ground_truth")
    given = rows.withColumn("sales", F.coalesce("sales", F.lit(0.0))) if daily else rows
    wanted = missing_runs(spark, f"{out}/forecasts") if skip_existing else list(RUNS)
    if wanted:
        made = runs.forecast_runs(given, test_size, only=tuple(wanted), origin=origin, model=model, extra=DAILY if daily else ())
        files.write_forecasts(made, f"{out}/forecasts", mode="append" if skip_existing else "overwrite")
    if daily:
        flags = test.select(F.col("store").alias("series_id"), F.col("idx").alias("step"), "open")
        told = spark.read.parquet(f"{out}/forecasts/run=covariate")
        relational.gated(told, flags).write.mode("overwrite").parquet(f"{out}/forecasts/run={GATED}")
        both = files.read_forecasts(spark, f"{out}/forecasts").filter(F.col("run").isin("univariate", "covariate", GATED)).join(truth, ["series_id", "step"]).join(flags, ["series_id", "step"])
        evaluate.mae_by_state(both, "open", ("run", "series_id")).write.mode("overwrite").parquet(f"{out}/mae_open_closed")
    if contexts:
        ablation(given, truth, out, contexts, test_size, model)
    evaluation(spark, out)
    drawn(spark, out)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("command", nargs="?", choices=("all", "evaluate", "figures"), default="all")
    parser.add_argument("--out", required=True)
    for name in ("facts", "dimension"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--csv", help="evaluate: a tree of CSV files to read in place of earlier forecasts")
    parser.add_argument("--test-size", type=int, default=runs.TEST_SIZE)
    parser.add_argument("--shortest", type=int, default=runs.SHORTEST)
    parser.add_argument("--skip-existing", action="store_true")
    parser.add_argument("--origin", choices=("split", "full"), default="split")
    parser.add_argument("--model", help="module:function, called on executors; gives predict")
    parser.add_argument("--daily", action="store_true")
    parser.add_argument("--contexts", type=int, nargs="*", default=[])
    a = parser.parse_args(arguments)
    if a.command == "all" and not (a.facts and a.dimension):
        parser.error("--facts and --dimension are needed")
    spark = SparkSession.builder.getOrCreate()
    if a.command == "evaluate":
        evaluation(spark, a.out, a.csv)
    elif a.command == "figures":
        drawn(spark, a.out)
    else:
        run(spark, a.facts, a.dimension, a.out, a.test_size, a.shortest, a.skip_existing, a.origin, a.model and forecast.pretrained(a.model), a.daily, tuple(a.contexts))


if __name__ == "__main__":
    main()
