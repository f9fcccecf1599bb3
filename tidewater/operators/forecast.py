"""Forecasts of several quantiles: a built-in model in SQL functions, and a host for models in Python.

A forecast has one row per series and step: p10, median, p90. The built-in model
repeats the last season and takes its quantiles from the series' own seasonal
differences. With covariates it adds the effect of each, the difference of the
target's mean where the covariate is above its own mean and where it is not (to four
places), times the covariate's change against the day repeated: to its value where
the future is known, else to its mean in the past (to six places).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.encode import scrubbed

LEVELS = (0.1, 0.5, 0.9)
SEASON = 7


def _season_and_spread(past: DataFrame, target: str, key: str, season: int):
    w = Window.partitionBy(key).orderBy("idx")
    spread = past.withColumn("__d", F.col(target) - F.lag(target, season).over(w)).groupBy(key).agg(F.percentile("__d", 0.1).alias("__low"), F.percentile("__d", 0.9).alias("__high"), F.count("*").alias("__n"))
    last = past.join(spread, key).filter(F.col("idx") >= F.col("__n") - season)
    return last, spread


def seasonal_naive(past: DataFrame, horizon: int = 30, target: str = "sales", key: str = "store", season: int = SEASON) -> DataFrame:
    """series_id, step, p10, median, p90. Series of season rows or fewer have null bounds, and only the steps their rows give."""
    last, _ = _season_and_spread(past, target, key, season)
    base = F.col("idx") - (F.col("__n") - season)
    steps = F.sequence(base, F.lit(horizon - 1), F.lit(season).cast("long"))
    rows = last.filter(base < horizon).select(key, F.explode(steps).alias("step"), target, "__low", "__high")
    median = F.col(target).cast("double")
    return rows.select(F.col(key).alias("series_id"), F.col("step").cast("long").alias("step"), F.round(median + F.col("__low"), 6).alias("p10"), F.round(median, 6).alias("median"), F.round(median + F.col("__high"), 6).alias("p90"))


def covariate_naive(past: DataFrame, future: DataFrame, known: Iterable[str], horizon: int = 30, target: str = "sales", key: str = "store", season: int = SEASON, observed: Iterable[str] = ()) -> DataFrame:
    """seasonal_naive moved by the effects of covariates: known ones by their future, observed ones by their past alone.

    future: key, idx from 0 and the known covariates; a known covariate without a
    value ahead counts as observed, a null before as 0, and a covariate that is never
    both above its mean and not has no effect.
    """
    known, names = list(known), sorted({*known, *observed})
    base = seasonal_naive(past, horizon, target, key, season)
    if not names:
        return base
    whole = Window.partitionBy(key)
    rows = past.select(key, "idx", target, *names).withColumns({f"__mean_{c}": F.round(F.avg(c).over(whole), 6) for c in names})
    above = lambda c: F.col(c) > F.col(f"__mean_{c}")
    effect = lambda c: F.round(F.coalesce(F.avg(F.when(above(c), F.col(target))) - F.avg(F.when(~above(c), F.col(target))), F.lit(0.0)), 4)
    effects = rows.groupBy(key).agg(*[x for c in names for x in (effect(c).alias(f"__effect_{c}"), F.first(f"__mean_{c}").alias(f"__mean_{c}"))], F.count("*").alias("__n"))
    before = past.join(effects, key).select(F.col(key).alias("series_id"), (F.col("idx") - (F.col("__n") - season)).alias("__phase"), *[F.col(c).alias(f"__before_{c}") for c in names], *[f"__{x}_{c}" for c in names for x in ("effect", "mean")]).filter("__phase >= 0")
    ahead = future.select(F.col(key).alias("series_id"), F.col("idx").alias("step"), *[F.col(c).alias(f"__ahead_{c}") for c in known])
    rows = base.withColumn("__phase", F.col("step") % season).join(before, ["series_id", "__phase"]).join(ahead, ["series_id", "step"], "left")
    move = F.lit(0.0)
    for c in names:
        to = [F.col(f"__ahead_{c}").cast("double")] if c in known else []
        move = move + F.col(f"__effect_{c}") * (F.coalesce(*to, F.col(f"__mean_{c}"), F.lit(0.0)) - F.coalesce(F.col(f"__before_{c}").cast("double"), F.lit(0.0)))
    return rows.select("series_id", "step", *[F.round(F.col(c) + move, 6).alias(c) for c in ("p10", "median", "p90")])


def tasks(past: DataFrame, covariates: Iterable[str], known_future: Iterable[str] = (), future: DataFrame | None = None, horizon: int = 30, target: str = "sales", key: str = "store") -> DataFrame:
    """One row a series, as models take them: target, past_covariates and future_covariates (maps of arrays of floats, in order).

    future: key, idx and the covariates whose future is known; without it their
    last `horizon` past values are replayed. Missing numbers become 0.
    """
    names = sorted(set(covariates) | set(known_future))
    known = sorted(known_future)

    def arrays(df: DataFrame, columns: list[str]) -> DataFrame:
        rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", *columns))).alias("__rows"))
        values = lambda c: F.transform("__rows", lambda r: scrubbed(r[c]).cast("float"))
        return rows.select(key, *[values(c).alias(c) for c in columns])

    def as_map(columns: list[str], last: int | None = None):
        value = lambda c: F.slice(c, -last, last) if last else F.col(c)
        pairs = [x for c in columns for x in (F.lit(c), value(c))]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<float>>")

    own = arrays(past, [target, *names])
    out = own.select(key, F.col(target).alias("target"), as_map(names).alias("past_covariates"), as_map(known, horizon).alias("__replayed"))
    if future is None or not known:
        return out.withColumnRenamed("__replayed", "future_covariates")
    return out.drop("__replayed").join(arrays(future.filter(F.col("idx") < horizon), known).select(key, as_map(known).alias("future_covariates")), key, "left")


def task_shapes(task_rows: DataFrame, key: str = "store") -> DataFrame:
    """For a look at what a model is given: the length of each series' target and of its covariates, past and future."""
    sizes = lambda m: F.transform_values(F.coalesce(F.col(m), F.create_map().cast("map<string,array<float>>")), lambda _, v: F.size(v))
    return task_rows.select(key, F.size("target").alias("target"), sizes("past_covariates").alias("past_covariates"), sizes("future_covariates").alias("future_covariates"))


def hosted(task_rows: DataFrame, load: Callable[[], Callable], horizon: int = 30, levels: Iterable[float] = LEVELS, key: str = "store") -> DataFrame:
    """Forecasts of a model in Python, long: series_id, step, quantile, value.

    load() runs once a worker task and gives predict(target, past, future, horizon,
    levels) -> array of (levels, horizon). Quantiles are asked for by level. Rows
    go through in Arrow batches, one series each; series are never grouped anew.
    """
    levels = list(levels)

    def run(frames):
        import numpy as np
        import pandas as pd

        predict = load()
        for frame in frames:
            for series, target, past, future in zip(frame[key], frame["target"], frame["past_covariates"], frame["future_covariates"], strict=True):
                pairs = lambda m: {k: np.asarray(v, np.float32) for k, v in (dict(m) if m is not None else {}).items()}
                got = np.asarray(predict(np.asarray(target, np.float32), pairs(past), pairs(future), horizon, levels), float)
                if got.shape != (len(levels), horizon):
                    raise ValueError(f"a model gave {got.shape}, not {(len(levels), horizon)}")
                yield pd.DataFrame({"series_id": series, "step": np.tile(np.arange(horizon), len(levels)), "quantile": np.repeat(levels, horizon), "value": got.ravel()})

    return task_rows.mapInPandas(run, f"series_id {dict(task_rows.dtypes)[key]}, step long, quantile double, value double")


def widened(long: DataFrame) -> DataFrame:
    """p10, median, p90 from rows by quantile level."""
    pick = lambda q: F.max(F.when(F.abs(F.col("quantile") - q) < 1e-9, F.col("value")))
    return long.groupBy("series_id", "step").agg(pick(0.1).alias("p10"), pick(0.5).alias("median"), pick(0.9).alias("p90"))


def pretrained(factory: str, *arguments) -> Callable[[], Callable]:
    """A loader of an external model, for `hosted`: "module:function", imported and called on the executors only, gives predict."""

    def load():
        import importlib

        module, _, name = factory.partition(":")
        return getattr(importlib.import_module(module), name)(*arguments)

    return load


def repeated_season() -> Callable[[], Callable]:
    """A loader of the seasonal model in numpy, to try `hosted` with."""

    def load():
        import numpy as np

        def predict(target, past, future, horizon, levels):
            target = target.astype(float)
            spread = np.quantile(target[SEASON:] - target[:-SEASON], levels) if len(target) > SEASON else np.zeros(len(levels))
            spread = spread - (spread[levels.index(0.5)] if 0.5 in levels else 0)
            return target[-SEASON:][np.arange(horizon) % min(SEASON, len(target))] + spread[:, None]

        return predict

    return load
