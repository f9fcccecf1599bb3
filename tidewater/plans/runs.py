"""The whole batch: processed series, split, all forecast runs, truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import forecast, perturb, relational
from tidewater.plans.settle import settled
from tidewater.sources import series

TEST_SIZE, SHORTEST = 30, 120
#: Covariates whose future the baseline is told, and all that runs may have.
COVARIATES = ("promo", "school_holiday")
ALL_COVARIATES = ("customers", "noise_random", "open", "promo", "school_holiday")


def processed(spark: SparkSession, sf_dir: str, shortest: int = SHORTEST) -> DataFrame:
    """Open days with sales, gaps filled, idx; series of more than `shortest` rows."""
    return relational.long_enough(series.indexed(relational.clean(series.train(spark, sf_dir))), shortest)


def truth(test: DataFrame, key: str = "store", target: str = "sales") -> DataFrame:
    return test.select(F.col(key).alias("series_id"), F.col("idx").alias("step"), F.col(target).alias("y_true"))


def _told(df: DataFrame, run: str, known: tuple[str, ...], extra: tuple[str, ...]) -> DataFrame:
    """A run's rows: all covariates it has as they were, and those whose future it knows once more as ahead_*; others are null."""
    value = lambda c, there: (F.col(c) if there else F.lit(None)).cast("double")
    columns = [value(c, c in df.columns).alias(c) for c in (*ALL_COVARIATES, *extra)]
    return df.select(F.lit(run).alias("run"), "store", "idx", "sales", *columns, *[value(c, c in known).alias(f"ahead_{c}") for c in (*COVARIATES, *extra)])


def _only(named: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """The entries of a map of covariates that the row's run has."""
    of = F.create_map(*[x for run, some in names.items() for x in (F.lit(run), F.array(*[F.lit(c) for c in some]).cast("array<string>"))])
    return F.map_filter(named, lambda c, _: F.array_contains(of[F.substring_index("key", ":", 1)], c))


def forecast_runs(rows: DataFrame, test_size: int = TEST_SIZE, long_horizon: int = 90, only: tuple[str, ...] | None = None, origin: str = "split", model: Callable[[], Callable] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """run, series_id, step, p10, median, p90 of all runs, or of those named.

    Every perturbed run is forecast from its own changed covariates; all runs with
    covariates go through one plan, keyed by run and series, and runs that are not
    asked for are not computed. Origin "split" forecasts the test rows from what is
    before them; "full" forecasts on from the end of the series and, as no future is
    given, replays the last test_size values of known covariates. model, a loader for
    forecast.hosted, takes the place of the built-in model in every run; extra names
    further covariates, whose future every run but the univariate ones is told. rows is
    read several times: pass a settled table.
    """
    if origin not in ("split", "full"):
        raise ValueError(f"no such origin: {origin}")
    wanted = lambda run: only is None or run in only
    past = rows if origin == "full" else relational.split(rows, test_size)[0]
    alone = lambda n: forecast.seasonal_naive(past, n) if model is None else forecast.widened(forecast.hosted(forecast.tasks(past, (), horizon=n), model, n))
    parts = [alone(n).withColumn("run", F.lit(run)) for run, n in (("univariate", test_size), ("long_horizon", long_horizon)) if wanted(run)]
    # Only what runs may have goes through their changes; a wide table's other columns would be read for nothing.
    lean = rows.select("store", "idx", "sales", *[c for c in (*ALL_COVARIATES, *extra) if c in rows.columns])
    if any(wanted(r) for r in perturb.PERTURBATIONS if r != "long_horizon"):
        lean = settled(perturb.sized(lean))
    changed = {"covariate": (lean, COVARIATES)} if wanted("covariate") else {}
    changed |= {run: (p.apply(lean), tuple(p.known_future)) for run, p in perturb.PERTURBATIONS.items() if run != "long_horizon" and wanted(run)}
    if changed:
        told = [_told(df, run, (*known, *extra), extra) for run, (df, known) in changed.items()]
        every = told[0]
        for one in told[1:]:
            every = every.unionByName(one)
        every = settled(every.withColumn("key", F.concat_ws(":", "run", F.col("store").cast("string"))))
        told_past, told_test = relational.split(every, test_size, "key")
        names = (*COVARIATES, *extra)
        ahead = told_test.select("key", "idx", *[F.col(f"ahead_{c}").alias(c) for c in names])
        before = every if origin == "full" else told_past
        if model is None:
            moved = forecast.covariate_naive(before, ahead, names, test_size, "sales", "key", observed=(*ALL_COVARIATES, *extra))
        else:
            # A model must not see the zeros that stand for a covariate the run has not, or whose future it is not told.
            own = {run: tuple(c for c in (*ALL_COVARIATES, *extra) if c in df.columns) for run, (df, _) in changed.items()}
            future = {run: tuple(c for c in (*known, *extra) if c in own[run]) for run, (_, known) in changed.items()}
            tasks = forecast.tasks(before, (*ALL_COVARIATES, *extra), names, None if origin == "full" else ahead, test_size, "sales", "key")
            tasks = tasks.withColumns({"past_covariates": _only(F.col("past_covariates"), own), "future_covariates": _only(F.col("future_covariates"), future)})
            moved = forecast.widened(forecast.hosted(tasks, model, test_size, key="key"))
        parts.append(moved.withColumn("run", F.substring_index("series_id", ":", 1)).withColumn("series_id", F.substring_index("series_id", ":", -1).cast("long")))
    if not parts:
        raise ValueError(f"no such runs: {only}")
    columns = ["run", "series_id", "step", "p10", "median", "p90"]
    out = parts[0].select(columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(columns))
    return out


def context_forecasts(past: DataFrame, lengths=(128, 256, 512), horizon: int = TEST_SIZE, model: Callable[[], Callable] | None = None) -> DataFrame:
    """context_len, series_id, step, p10, median, p90: the built-in model, or the one given, on the last L rows of the past, for every L."""
    cut = relational.contexts(past, lengths).withColumn("key", F.concat_ws(":", F.col("context_len").cast("string"), F.col("store").cast("string")))
    cut = series.indexed(cut.drop("idx"), "key", "dt")
    f = forecast.seasonal_naive(cut, horizon, "sales", "key") if model is None else forecast.widened(forecast.hosted(forecast.tasks(cut, (), horizon=horizon, key="key"), model, horizon, key="key"))
    f = f.withColumn("context_len", F.substring_index("series_id", ":", 1).cast("long"))
    return f.withColumn("series_id", F.substring_index("series_id", ":", -1).cast("long")).select("context_len", "series_id", "step", "p10", "median", "p90")


def scored_contexts(rows: DataFrame, lengths=(128, 256, 512), test_size: int = TEST_SIZE) -> DataFrame:
    """context_len, series_id, wql of the forecasts from every context."""
    from tidewater.operators import evaluate

    past, test = relational.split(rows, test_size)
    f = context_forecasts(past, lengths, test_size)
    return f.join(truth(test), ["series_id", "step"]).groupBy("context_len", "series_id").agg(F.round(evaluate.wql(), 6).alias("wql"))
