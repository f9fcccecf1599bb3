"""Joins, filters, fills, splits and slices over series keyed by a column and ordered by another.

Every window is partitioned by the series; idx is the 0-based place of a row in it.
Fills and splits take key None for a table that is one series, in the order of the
columns given; then idx is added and no window spans the rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.encode import numeric_columns
from tidewater.operators import single


def left_join(fact: DataFrame, dim: DataFrame, key: str, match_nulls: bool = False) -> DataFrame:
    """All rows of fact with the columns of dim; other columns of one name get _x and _y.

    SQL semantics: a null key matches nothing, unless match_nulls is set. Several
    rows of dim with one key give as many rows.
    """
    both = set(fact.columns) & set(dim.columns) - {key}
    left = fact.select(*[F.col(c).alias(f"{c}_x" if c in both else c) for c in fact.columns])
    right = dim.select(*[F.col(c).alias("__key" if c == key else f"{c}_y" if c in both else c) for c in dim.columns])
    on = left[key].eqNullSafe(right["__key"]) if match_nulls else left[key] == right["__key"]
    return left.join(right, on, "left").drop("__key")


def open_rows(df: DataFrame, flag: str = "open") -> DataFrame:
    """Rows whose flag is 1; a missing flag is not."""
    return df.filter(F.col(flag) == 1)


def with_target(df: DataFrame, target: str = "sales") -> DataFrame:
    return df.na.drop(subset=[target])


def _filled(df: DataFrame, key: str | None, order: str | Iterable[str], columns: Iterable[str] | None, backward: bool) -> DataFrame:
    if key is None:
        by = [order] if isinstance(order, str) else list(order)
        return single.filled(single.place(df, by), columns or [c for c in df.columns if c not in by], backward)
    # What follows a row is what precedes it in the other order, so both frames only ever grow.
    up, down = (Window.partitionBy(key).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(order).asc(), F.col(order).desc()))
    names = [c for c in (columns or df.columns) if c not in (key, order)]
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    value = lambda c: F.coalesce(last(c, up), last(c, down)) if backward else last(c, up)
    return df.select(*[value(c).alias(c) if c in names else F.col(c) for c in df.columns])


def forward_fill(df: DataFrame, key: str | None = "store", order: str | Iterable[str] = "dt", columns: Iterable[str] | None = None) -> DataFrame:
    """The last value before a gap, in every column but key and order."""
    return _filled(df, key, order, columns, False)


def fill_both(df: DataFrame, key: str | None = "store", order: str | Iterable[str] = "dt", columns: Iterable[str] | None = None) -> DataFrame:
    """Forward fill, then what still misses at the start from the first value."""
    return _filled(df, key, order, columns, True)


def fill_zero(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return df.na.fill(0, list(columns or numeric_columns(df)))


def clean(df: DataFrame, key: str = "store", order: str = "dt") -> DataFrame:
    """Open rows with a target, gaps filled within the series."""
    return fill_both(with_target(open_rows(df)), key, order)


def split(df: DataFrame, test_size: int = 30, key: str | None = "store", order: str | Iterable[str] = "dt") -> tuple[DataFrame, DataFrame]:
    """(past, test): all but the last test_size rows of each series, and those, both with idx from 0.

    A series of test_size rows or fewer raises when the result is computed, or at
    once if the table is one series, whose order counts in place of idx.
    """
    if key is None:
        return single.split(single.place(df, order), test_size)
    n = F.count("*").over(Window.partitionBy(key))
    sized = df.withColumn("__n", n)
    guard = F.when(F.col("__n") <= test_size, F.raise_error(F.lit("Dataset too small for temporal split")).cast("long")).otherwise(F.col("__n"))
    sized = sized.withColumn("__n", guard)
    past = sized.filter(F.col("idx") < F.col("__n") - test_size).drop("__n")
    test = sized.filter(F.col("idx") >= F.col("__n") - test_size).withColumn("idx", F.col("idx") - F.col("__n") + test_size).drop("__n")
    return past, test


def long_enough(df: DataFrame, rows: int, key: str = "store") -> DataFrame:
    """Series of more than `rows` rows."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(key))).filter(F.col("__n") > rows).drop("__n")


def without(df: DataFrame, *columns: str) -> DataFrame:
    """Columns dropped; names that are not there are ignored."""
    return df.drop(*columns)


def sorted_columns(df: DataFrame, first: Iterable[str] = ()) -> DataFrame:
    first = list(first)
    return df.select(*first, *sorted(c for c in df.columns if c not in first))


def covariate_names(df: DataFrame, target: str, also: Iterable[str] = (), without: Iterable[str] = ()) -> list[str]:
    """Numeric columns but target and `without`, together with `also`; a name that is not there raises."""
    missing = [c for c in also if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return sorted({*numeric_columns(df, (target, *without)), *also})


def numeric_profile(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """covariate, n, null_share, least, greatest of each named column: one aggregate over the table, no row of it to the driver."""
    names = list(names)
    one = lambda i, c: [F.count(c).alias(f"n_{i}"), F.min(c).cast("double").alias(f"least_{i}"), F.max(c).cast("double").alias(f"greatest_{i}")]
    wide = df.agg(F.count("*").alias("n"), *[x for i, c in enumerate(names) for x in one(i, c)])
    items = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col("n"), (1 - F.col(f"n_{i}") / F.greatest("n", F.lit(1))).alias("null_share"), F.col(f"least_{i}").alias("least"), F.col(f"greatest_{i}").alias("greatest")) for i, c in enumerate(names)])
    return wide.select(F.explode(items).alias("x")).select("x.*")


def tail(df: DataFrame, horizon: int, key: str = "store") -> DataFrame:
    """The last `horizon` rows of each series, with step from 0. Only the rank by group limit is sorted."""
    w = Window.partitionBy(key).orderBy(F.col("idx").desc())
    last = df.withColumn("__back", F.row_number().over(w)).filter(F.col("__back") <= horizon)
    return last.withColumn("step", (F.lit(horizon) - F.col("__back")).cast("long")).drop("__back")


def case_window(df: DataFrame, past: int = 60, future: int = 30, key: str = "store") -> DataFrame:
    """The last past + future rows, marked by segment, with x from 0."""
    last = tail(df, past + future, key).withColumnRenamed("step", "x")
    return last.withColumn("segment", F.when(F.col("x") < past, "past").otherwise("future"))


def appended(past: DataFrame, future: DataFrame, key: str = "store") -> DataFrame:
    """Future rows after the past ones of each series, x counting on."""
    n = past.groupBy(key).agg(F.count("*").alias("__n"))
    later = future.join(n, key, "left").withColumn("x", F.col("idx") + F.coalesce("__n", F.lit(0))).drop("__n")
    return past.withColumns({"x": F.col("idx"), "segment": F.lit("past")}).unionByName(later.withColumn("segment", F.lit("future")))


def by_step(a: DataFrame, b: DataFrame, keys: Iterable[str] = ("series_id", "step"), strict: bool = True) -> DataFrame:
    """Rows of a and b of one step side by side. Unequal lengths raise, or, if not strict, give no rows for that series."""
    keys = list(keys)
    both = a.withColumn("__in_a", F.lit(1)).join(b.withColumn("__in_b", F.lit(1)), keys, "full")
    own = Window.partitionBy(*keys[:-1])
    na, nb = (F.count(c).over(own) for c in ("__in_a", "__in_b"))
    sized = both.withColumns({"__na": na, "__nb": nb})
    differ = F.col("__na") != F.col("__nb")
    fail = F.raise_error(F.format_string("Length mismatch: %d and %d", "__na", "__nb")).cast("boolean") if strict else F.lit(False)
    kept = sized.filter(F.when(differ, fail).otherwise(F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull()))
    return kept.drop("__in_a", "__in_b", "__na", "__nb")


def fan_out(base: DataFrame, runs: DataFrame, keys: Iterable[str] = ("series_id", "step")) -> DataFrame:
    """All runs against one base in one job: columns of base get the prefix base_."""
    keys = list(keys)
    return runs.join(base.select(*keys, *[F.col(c).alias(f"base_{c}") for c in base.columns if c not in keys and c != "run"]), keys)


def reindexed(df: DataFrame, key: str = "store", date: str = "dt") -> DataFrame:
    """Every day from the first to the last of each series; new days have nulls and is_gap 1."""
    span = df.groupBy(key).agg(F.min(date).alias("__a"), F.max(date).alias("__b"))
    days = span.select(key, F.explode(F.sequence("__a", "__b")).alias(date))
    return days.join(df.withColumn("__there", F.lit(1)), [key, date], "left").withColumn("is_gap", F.when(F.col("__there").isNull(), 1).otherwise(0).cast("long")).drop("__there")


def validity(df: DataFrame, key: str = "store", date: str = "dt", target: str = "sales", covariates: Iterable[str] = (), min_run: int = 60, min_obs: int = 120, window: int = 90, zero_max: int = 14, zero_share: float = 0.5) -> DataFrame:
    """One row a series: n_obs, longest_run (days in a row), recent_days, recent_covariates, zero_tail, zero_part, is_valid.

    The recent window is the last `window` days before the series' last day. A
    series is valid with enough observations, a long enough run, no day missing
    and no covariate null in the recent window, and few enough zeros at its end
    (as a run and as a share of the window).
    """
    w = Window.partitionBy(key).orderBy(date)
    all_days = Window.partitionBy(key)
    rows = df.withColumn("__last", F.max(date).over(all_days)).withColumn("__island", F.date_sub(date, F.row_number().over(w)))
    rows = rows.withColumn("__run", F.count("*").over(Window.partitionBy(key, "__island")))
    rows = rows.withColumn("__recent", F.datediff("__last", date) < window)
    rows = rows.withColumn("__nonzero_after", F.max((F.col(target) != 0).cast("int")).over(Window.partitionBy(key).orderBy(F.col(date).desc()).rowsBetween(Window.unboundedPreceding, 0)))
    complete = F.lit(True)
    for c in covariates:
        complete = complete & F.col(c).isNotNull()
    out = rows.groupBy(key).agg(
        F.count(target).alias("n_obs"),
        F.max("__run").alias("longest_run"),
        F.count_if("__recent").alias("recent_days"),
        F.count_if(F.col("__recent") & complete).alias("recent_covariates"),
        F.count_if(F.col("__nonzero_after") == 0).alias("zero_tail"),
        (F.count_if(F.col("__recent") & (F.col(target) == 0)) / F.greatest(F.count_if("__recent"), F.lit(1))).alias("zero_part"),
    )
    ok = (F.col("n_obs") >= min_obs) & (F.col("longest_run") >= min_run) & (F.col("recent_days") >= window) & (F.col("recent_covariates") == F.col("recent_days")) & (F.col("zero_tail") <= zero_max) & (F.col("zero_part") <= zero_share)
    return out.withColumn("is_valid", ok.cast("long"))


def only_valid(df: DataFrame, report: DataFrame, key: str = "store") -> DataFrame:
    return df.join(report.filter("is_valid = 1").select(key), key, "left_semi")


def long_names(df: DataFrame, key: str, date: str, target: str, covariates: Iterable[str] = ()) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(date).alias("timestamp"), F.col(target).alias("target"), *covariates)


def contexts(past: DataFrame, lengths: Iterable[int] = (128, 256, 512), key: str = "store") -> DataFrame:
    """The last L rows of each series for every L, by context_len; a row goes only to the lengths that hold it."""
    n = F.count("*").over(Window.partitionBy(key))
    fits = F.filter(F.array(*[F.lit(int(x)) for x in lengths]), lambda x: F.col("idx") >= F.col("__n") - x)
    return past.withColumn("__n", n).withColumn("context_len", F.explode(fits)).drop("__n").withColumn("context_len", F.col("context_len").cast("long"))


def outliers(df: DataFrame, value: str = "wql", by: Iterable[str] = (), fence: float = 1.5) -> DataFrame:
    """Adds is_outlier: value above the third quartile plus fence times the quartiles' distance."""
    quartile = lambda p: F.percentile(value, p)
    by = list(by)
    limits = df.groupBy(*by).agg((quartile(0.75) + fence * (quartile(0.75) - quartile(0.25))).alias("__limit"))
    joined = df.join(limits, by) if by else df.join(F.broadcast(limits), F.lit(True))
    return joined.withColumn("is_outlier", (F.col(value) > F.col("__limit")).cast("long")).drop("__limit")


def ranked_series(df: DataFrame, value: str = "mae", key: str = "store", k: int = 3) -> DataFrame:
    """The k series of largest value (bad) and the k of smallest (good) with their rank; ties go to the smaller key. Two top-k scans, no global sort."""
    worst = df.orderBy(F.col(value).desc(), key).limit(k).withColumn("kind", F.lit("bad"))
    best = df.orderBy(F.col(value), key).limit(k).withColumn("kind", F.lit("good"))
    w = Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "bad", -F.col(value)).otherwise(F.col(value)), key)
    return worst.unionByName(best).withColumn("rank", F.row_number().over(w).cast("long"))


def gated(forecast: DataFrame, flags: DataFrame, keys: Iterable[str] = ("series_id", "step"), flag: str = "open") -> DataFrame:
    """Forecast values times the flag of their step; without a flag they stay."""
    values = [c for c in forecast.columns if c in ("p10", "median", "p90")]
    joined = forecast.join(flags.select(*keys, F.col(flag).alias("__flag")), list(keys), "left")
    return joined.withColumns({c: F.col(c) * F.coalesce("__flag", F.lit(1)) for c in values}).drop("__flag")


def selection(df: DataFrame, value: str = "mae", key: str = "store", k: int = 3, sample: int = 5, seed: int = 42) -> DataFrame:
    """Which series to draw: the k worst and k best, and of the others `sample` by a hash of seed and key; kind bad, good or other, with rank.

    Best and worst are disjoint where there are 2 k series; a series that is both is
    listed as both. Three top-k scans, no global sort.
    """
    ranked = ranked_series(df, value, key, k)
    others = df.join(ranked.select(key), key, "left_anti").withColumn("__order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    some = others.orderBy("__order", key).limit(sample).withColumn("kind", F.lit("other"))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("__order", key)).cast("long")).drop("__order")
    return ranked.unionByName(some)
