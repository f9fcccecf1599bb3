"""Every operator as a query over the Parquet tables, with its SQL for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import calendar, encode, table
from tidewater.operators import evaluate, forecast, perturb, relational, sessions, single, sketches, timed, zoned
from tidewater.plans import figures, report, runs
from tidewater.plans.settle import settled
from tidewater.sources import series

QUERIES: dict = {}
SQL: dict = {}


def _normal(label: str) -> str:
    u = lambda at: f"((('0x' || substr(md5('{label}:42:' || store || ':' || idx), {at}, 8))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE"
    return f"round(sqrt(-2 * ln({u(1)})) * cos(2 * pi() * ({u(9)})), 9)"


def _told_sql() -> str:
    """Covariates of every run as it is told them, their effects, and the forecasts of all runs."""
    own = {c: f"{c}::DOUBLE" for c in ("customers", "open", "promo", "school_holiday")}
    masked = "idx >= trunc(n * (1::DOUBLE - 0.3::DOUBLE))"
    changed = {
        "covariate": ("series", {}, ("promo", "school_holiday")),
        "noise": ("series", {"noise_random": _normal("noise")}, ()),
        "strong_noise": ("series", {c: f"coalesce({c}, 0) + 10 * {_normal(c)}" for c in own}, ()),
        "shuffle": ("shuffled", {}, ("promo",)),
        "missing_future": ("series", {"school_holiday": "(CASE WHEN idx >= n - 30 THEN 0 ELSE school_holiday END)::DOUBLE"}, ("school_holiday",)),
        "time_shift": ("shifted", {}, ("promo",)),
        "trend_break": ("series", {"promo": "CASE WHEN idx >= trunc(n * 0.8::DOUBLE) THEN promo * 1.5::DOUBLE ELSE promo END"}, ("promo",)),
        "feature_drop": ("series", {"promo": "NULL", "school_holiday": "NULL"}, ()),
        "partial_mask": ("series", {c: f"CASE WHEN {masked} THEN 0 ELSE {c} END" for c in own}, ()),
        "scaling": ("series", {c: f"{c} * 2::DOUBLE" for c in own}, ()),
    }
    parts = []
    for run, (source, new, known) in changed.items():
        value = {"noise_random": "NULL"} | own | new
        columns = [f"({value[c]})::DOUBLE AS {c}" for c in runs.ALL_COVARIATES]
        columns += [f"({value[c] if c in known else 'NULL'})::DOUBLE AS ahead_{c}" for c in runs.COVARIATES]
        parts.append(f"SELECT '{run}' AS run, store, idx, n, sales, {', '.join(columns)} FROM {source}")
    mean = ", ".join(f"round(avg({c}) OVER (PARTITION BY run, store), 6) AS mean_{c}" for c in runs.ALL_COVARIATES)
    effect = ", ".join(f"round(coalesce(avg(sales) FILTER ({c} > mean_{c}) - avg(sales) FILTER (NOT {c} > mean_{c}), 0), 4) AS by_{c}, any_value(mean_{c}) AS mean_{c}" for c in runs.ALL_COVARIATES)
    to = lambda c: f"coalesce(a.ahead_{c}, mean_{c}, 0)" if c in runs.COVARIATES else f"coalesce(mean_{c}, 0)"
    move = "0::DOUBLE + " + " + ".join(f"by_{c} * ({to(c)} - coalesce(b.{c}, 0))" for c in runs.ALL_COVARIATES)
    return f"""told AS ({' UNION ALL '.join(parts)}),
meant AS (SELECT *, {mean} FROM told WHERE idx < n - 30),
effects AS (SELECT run, store, {effect} FROM meant GROUP BY run, store),
moved AS (
  SELECT e.run, f.series_id, f.step, f.p10, f.median, f.p90, {move} AS move
  FROM naive f JOIN effects e ON e.store = f.series_id
  JOIN told b ON b.run = e.run AND b.store = e.store AND b.idx = b.n - 37 + f.step % 7
  LEFT JOIN told a ON a.run = e.run AND a.store = e.store AND a.idx = a.n - 30 + f.step
  WHERE f.step < 30),
forecasts AS (
  SELECT 'univariate' AS run, * FROM naive WHERE step < 30
  UNION ALL SELECT 'long_horizon', * FROM naive
  UNION ALL SELECT run, series_id, step, round(p10 + move, 6), round(median + move, 6), round(p90 + move, 6) FROM moved),"""


#: Tables that the SQL of all queries builds on.
PRELUDE = """WITH daily AS (
  SELECT c_nationkey::BIGINT AS store, o_orderdate::DATE AS dt, (sum(round(o_totalprice * 100)::BIGINT)::BIGINT)::DOUBLE / 100::DOUBLE AS sales,
    count(DISTINCT o_custkey) AS customers, max(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS promo
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
keyed AS (SELECT *, store * 31 + dayofyear(dt) AS k FROM daily),
train AS (
  SELECT store, dt, CASE WHEN k % 17 <> 0 THEN sales END AS sales, (CASE WHEN k % 13 = 0 THEN 0 WHEN k % 29 <> 0 THEN 1 END)::BIGINT AS open, promo,
    CASE WHEN k % 19 <> 0 THEN (month(dt) IN (7, 8))::BIGINT END AS school_holiday,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN 'a' WHEN k % 5 = 0 THEN 'b' ELSE '0' END AS state_holiday, customers
  FROM keyed),
store_dim AS (
  SELECT n_nationkey::BIGINT AS store, n_name AS store_name, r_name AS region, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 10::DOUBLE END AS competition
  FROM nation JOIN region ON n_regionkey = r_regionkey),
opened AS (SELECT * FROM train WHERE open = 1 AND sales IS NOT NULL),
filled AS (
  SELECT store, dt, sales, open, promo,
    coalesce(last_value(school_holiday IGNORE NULLS) OVER b, first_value(school_holiday IGNORE NULLS) OVER a) AS school_holiday,
    coalesce(last_value(state_holiday IGNORE NULLS) OVER b, first_value(state_holiday IGNORE NULLS) OVER a) AS state_holiday, customers
  FROM opened
  WINDOW b AS (PARTITION BY store ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY store ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
placed AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY dt) - 1 AS idx, count(*) OVER (PARTITION BY store) AS n FROM filled),
series AS (SELECT * FROM placed WHERE n > 120),
past AS (SELECT * FROM series WHERE idx < n - 30),
test AS (SELECT * EXCLUDE (idx), idx - n + 30 AS idx FROM series WHERE idx >= n - 30),
truth AS (SELECT store AS series_id, idx AS step, sales AS y_true FROM test),
steps AS (SELECT unnest(range(90)) AS step),
spread AS (
  SELECT store, quantile_cont(d, 0.1) AS low, quantile_cont(d, 0.9) AS high, count(*) AS m
  FROM (SELECT store, sales - lag(sales, 7) OVER (PARTITION BY store ORDER BY idx) AS d FROM past) GROUP BY store),
naive AS (
  SELECT past.store AS series_id, step, round(sales + low, 6) AS p10, round(sales, 6) AS median, round(sales + high, 6) AS p90
  FROM past JOIN spread USING (store) JOIN steps ON past.idx - (m - 7) = step % 7 WHERE past.idx >= m - 7),
shuffled AS (
  SELECT s.* EXCLUDE (promo), d.promo FROM series s JOIN (
    SELECT store, promo, row_number() OVER (PARTITION BY store ORDER BY md5('42:' || store || ':' || idx), idx) - 1 AS idx FROM series) d USING (store, idx)),
shifted AS (SELECT s.* EXCLUDE (promo), d.promo FROM series s JOIN (SELECT store, promo, (idx + 7) % n AS idx FROM series) d USING (store, idx)),
{told}
fanned AS (
  SELECT f.*, b.p10 AS base_p10, b.median AS base_median, b.p90 AS base_p90
  FROM forecasts f JOIN forecasts b ON b.run = 'covariate' AND f.series_id = b.series_id AND f.step = b.step WHERE f.run NOT IN ('univariate', 'covariate', 'long_horizon')),
gapped AS (
  SELECT d.store, d.dt, t.sales, t.open, t.promo, t.school_holiday, t.state_holiday, t.customers, (t.store IS NULL)::BIGINT AS is_gap
  FROM (SELECT store, unnest(range(min(dt)::TIMESTAMP, max(dt)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS dt FROM train GROUP BY store) d LEFT JOIN train t ON d.store = t.store AND d.dt = t.dt),
flagged AS (SELECT *, CASE WHEN is_gap = 1 THEN 0 ELSE coalesce(open, 0) END AS flag FROM gapped),
contexts AS (
  SELECT l AS context_len, past.*, row_number() OVER (PARTITION BY l, store ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY l, store) AS c
  FROM past, unnest([128, 256, 512]) AS t(l) WHERE idx >= n - 30 - l),
context_spread AS (
  SELECT context_len, store, quantile_cont(d, 0.1) AS low, quantile_cont(d, 0.9) AS high, any_value(c) AS c
  FROM (SELECT context_len, store, c, sales - lag(sales, 7) OVER (PARTITION BY context_len, store ORDER BY i) AS d FROM contexts) GROUP BY 1, 2),
context_forecast AS (
  SELECT x.context_len, x.store AS series_id, step, round(sales + low, 6) AS p10, round(sales, 6) AS median, round(sales + high, 6) AS p90
  FROM contexts x JOIN context_spread s ON x.context_len = s.context_len AND x.store = s.store JOIN steps ON x.i - (s.c - 7) = step % 7 WHERE x.i >= s.c - 7 AND step < 30),
context_wql AS (
  SELECT context_len::BIGINT AS context_len, series_id,
    round(2 * sum(greatest(0.1::DOUBLE * (y_true - p10), (0.1::DOUBLE - 1) * (y_true - p10)) + greatest(0.5::DOUBLE * (y_true - median), (0.5::DOUBLE - 1) * (y_true - median)) + greatest(0.9::DOUBLE * (y_true - p90), (0.9::DOUBLE - 1) * (y_true - p90)))
      / (sum(abs(y_true)) + 1e-9) / 3, 6) AS wql
  FROM context_forecast JOIN truth USING (series_id, step) GROUP BY 1, 2),
scored AS (
  SELECT run, series_id,
    round(2 * sum(greatest(0.1::DOUBLE * (y_true - p10), (0.1::DOUBLE - 1) * (y_true - p10)) + greatest(0.5::DOUBLE * (y_true - median), (0.5::DOUBLE - 1) * (y_true - median)) + greatest(0.9::DOUBLE * (y_true - p90), (0.9::DOUBLE - 1) * (y_true - p90)))
      / (sum(abs(y_true)) + 1e-9) / 3, 6) AS wql,
    round(avg(abs(y_true - median)), 4) AS mae
  FROM forecasts JOIN truth USING (series_id, step) WHERE step < 30 GROUP BY 1, 2)
""".replace("{told}", _told_sql())


def _tables(prelude: str) -> dict[str, str]:
    """The prelude's tables by name, each with its SQL, in order."""
    heads = list(re.finditer(r"(?m)^(?:WITH )?(\w+) AS \(", prelude))
    ends = [x.start() for x in heads[1:]] + [len(prelude)]
    return {x[1]: prelude[x.end() : end].rstrip().rstrip(",").rstrip()[:-1] for x, end in zip(heads, ends, strict=True)}


TABLES = _tables(PRELUDE)
#: Read more than once in some queries, so made once.
ONCE = ("series", "naive", "told", "forecasts", "context_forecast")


def with_tables(sql: str) -> str:
    """sql with the tables of the prelude that it needs, and those that they need."""
    needed, seen = [sql], set()
    while needed:
        text = needed.pop()
        new = [t for t in TABLES if t not in seen and re.search(rf"\b{t}\b", text)]
        seen.update(new)
        needed += [TABLES[t] for t in new]
    parts = [f"{t} AS {'MATERIALIZED ' if t in ONCE else ''}({TABLES[t]})" for t in TABLES if t in seen]
    return (f"WITH {', '.join(parts)} " if parts else "") + sql


def query(sql: str | None = None):
    """Registers a function as a query under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_tables(sql)
        return f

    return add


def _train(spark: SparkSession, d: str) -> DataFrame:
    return series.train(spark, d)


def _series(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned series, computed once a query."""
    return settled(runs.processed(spark, d))


def _series_once(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned series for queries that read it once: nothing is written before."""
    return runs.processed(spark, d)


def _past(spark: SparkSession, d: str) -> DataFrame:
    return relational.split(_series(spark, d))[0]


def _univariate(spark: SparkSession, d: str) -> DataFrame:
    return forecast.seasonal_naive(_past(spark, d))


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The univariate forecast and the true values, from one table of series."""
    past, test = relational.split(_series(spark, d))
    return forecast.seasonal_naive(past), runs.truth(test)


def _forecasts(spark: SparkSession, d: str, *only: str) -> tuple[DataFrame, DataFrame]:
    """The runs named, or all, and the series they come from, each computed once."""
    rows = _series(spark, d)
    return settled(runs.forecast_runs(rows, only=only or None)), rows


def _truth_of(rows: DataFrame) -> DataFrame:
    return runs.truth(relational.split(rows)[1])


def _pair(spark: SparkSession, d: str) -> DataFrame:
    """The baseline and the shifted run, compared step by step."""
    f, _ = _forecasts(spark, d, "covariate", "time_shift")
    of = lambda name: f.filter(F.col("run") == name).drop("run")
    return figures.comparison(of("covariate"), of("time_shift"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """Days of every series with flag 1 where open, 0 where closed or without a row."""
    return relational.reindexed(_train(spark, d)).withColumn("flag", F.when(F.col("is_gap") == 1, 0).otherwise(F.coalesce("open", F.lit(0))).cast("long"))


#: The runs that are compared with the baseline.
TESTS = tuple(x for x in perturb.PERTURBATIONS if x != "long_horizon")
RAW = "store, dt, sales, open, promo, school_holiday, state_holiday, customers"
FULL = RAW + ", idx"


@query("SELECT store, dt, sales, open, promo, school_holiday, state_holiday, customers, store_name, region, competition FROM train LEFT JOIN store_dim USING (store)")
def b1_left_join(spark, d):
    return relational.left_join(_train(spark, d), series.store_dim(spark, d), "store")


@query(f"SELECT {RAW} FROM train WHERE open = 1")
def b2_filter_open(spark, d):
    return relational.open_rows(_train(spark, d))


@query(f"SELECT {RAW} FROM train WHERE sales IS NOT NULL")
def b3_dropna_target(spark, d):
    return relational.with_target(_train(spark, d))


def _fill_sql(backward: bool) -> str:
    b, a = "(PARTITION BY store ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "(PARTITION BY store ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    one = lambda c: f"coalesce(last_value({c} IGNORE NULLS) OVER {b}, first_value({c} IGNORE NULLS) OVER {a}) AS {c}" if backward else f"last_value({c} IGNORE NULLS) OVER {b} AS {c}"
    return "SELECT store, dt, " + ", ".join(map(one, ("sales", "open", "promo", "school_holiday", "state_holiday", "customers"))) + " FROM train"


@query(_fill_sql(False))
def b4_ffill(spark, d):
    return relational.forward_fill(_train(spark, d))


@query(_fill_sql(True))
def b5_bfill(spark, d):
    return relational.fill_both(_train(spark, d))


@query("SELECT store, dt, coalesce(sales, 0) AS sales, coalesce(open, 0) AS open, promo, coalesce(school_holiday, 0) AS school_holiday, state_holiday, customers FROM train")
def b6_fillna_zero(spark, d):
    return relational.fill_zero(_train(spark, d))


@query(f"SELECT {FULL} FROM past")
def b7_split_past(spark, d):
    return relational.split(_series_once(spark, d))[0]


@query(f"SELECT {FULL} FROM test")
def b7_split_test(spark, d):
    return relational.split(_series_once(spark, d))[1]


@query("SELECT store, idx, open, promo, school_holiday, state_holiday, customers FROM series")
def b8_drop_columns(spark, d):
    return relational.without(_series_once(spark, d), "sales", "dt", "not_there")


@query("SELECT store, idx, customers, open, promo, school_holiday FROM series")
def b9_covariates_sorted(spark, d):
    df = _series_once(spark, d)
    return relational.sorted_columns(df.select("store", "idx", "school_holiday", "promo", "open", "customers"), ("store", "idx"))


_NUMERIC = ("customers", "open", "promo", "sales", "school_holiday")


@query(" UNION ALL ".join(f"SELECT '{c}' AS covariate, count(*) AS n, round(1 - count({c}) / count(*), 9) AS null_share, min({c})::DOUBLE AS least, max({c})::DOUBLE AS greatest FROM train" for c in _NUMERIC))
def b10_numeric_columns(spark, d):
    rows = _train(spark, d)
    out = relational.numeric_profile(rows, relational.covariate_names(rows, "dt", ("promo",), ("store",)))
    return out.withColumn("null_share", F.round("null_share", 9))


@query("SELECT store, idx - n + 30 AS step, promo, school_holiday FROM series WHERE idx >= n - 30")
def b11_future_tail(spark, d):
    return relational.tail(_series_once(spark, d), 30).select("store", "step", "promo", "school_holiday")


@query("SELECT store, idx - n + 90 AS x, sales, CASE WHEN idx < n - 30 THEN 'past' ELSE 'future' END AS segment FROM series WHERE idx >= n - 90")
def b12_case_window(spark, d):
    return relational.case_window(_series_once(spark, d)).select("store", "x", "sales", "segment")


@query("SELECT store, idx AS x, sales, 'past' AS segment FROM past UNION ALL SELECT store, idx + n - 30, sales, 'future' FROM test")
def b13_append(spark, d):
    past, test = relational.split(_series(spark, d))
    return relational.appended(past, test).select("store", "x", "sales", "segment")


@query("SELECT series_id, step, median, y_true FROM naive JOIN truth USING (series_id, step)")
def b14_step_join(spark, d):
    f, truth = _scored(spark, d)
    return relational.by_step(f.select("series_id", "step", "median"), truth)


@query("SELECT series_id, step, median, y_true FROM naive JOIN truth USING (series_id, step) WHERE series_id % 2 = 0")
def b15_length_guard(spark, d):
    f, truth = _scored(spark, d)
    return relational.by_step(f.select("series_id", "step", "median"), truth.filter("series_id % 2 = 0 or step < 29"), strict=False)


@query("SELECT run, series_id, step, median, base_median FROM fanned")
def b17_fan_out(spark, d):
    f, _ = _forecasts(spark, d, "covariate", *TESTS)
    return relational.fan_out(f.filter("run = 'covariate'"), f.filter("run <> 'covariate'")).select("run", "series_id", "step", "median", "base_median")


@query(f"SELECT {RAW}, is_gap FROM gapped")
def b18_reindex(spark, d):
    return relational.reindexed(_train(spark, d))


@query("""SELECT store, n_obs, longest_run, recent_days, recent_covariates, zero_tail, round(zero_part, 6) AS zero_part,
  (n_obs >= 120 AND longest_run >= 5 AND recent_days >= 60 AND recent_covariates = recent_days AND zero_tail <= 14 AND zero_part <= 0.5)::BIGINT AS is_valid FROM (
  SELECT store, count(sales) AS n_obs, max(run) AS longest_run, count(*) FILTER (recent) AS recent_days, count(*) FILTER (recent AND school_holiday IS NOT NULL) AS recent_covariates,
    count(*) FILTER (after = 0) AS zero_tail, (count(*) FILTER (recent AND sales = 0))::DOUBLE / greatest(count(*) FILTER (recent), 1) AS zero_part
  FROM (SELECT *, count(*) OVER (PARTITION BY store, island) AS run FROM (
    SELECT *, dt - (row_number() OVER (PARTITION BY store ORDER BY dt))::INT AS island, max(dt) OVER (PARTITION BY store) - dt < 60 AS recent,
      max((sales <> 0)::INT) OVER (PARTITION BY store ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM train)) GROUP BY store)""")
def b19_validity(spark, d):
    out = relational.validity(_train(spark, d), covariates=("school_holiday",), min_run=5, window=60)
    return out.withColumn("zero_part", F.round("zero_part", 6))


@query("SELECT store AS id, dt AS timestamp, sales AS target, promo, school_holiday FROM series")
def b20_long_names(spark, d):
    return relational.long_names(_series_once(spark, d), "store", "dt", "sales", ("promo", "school_holiday"))


@query("SELECT context_len::BIGINT AS context_len, store, idx, sales FROM contexts")
def b21_context(spark, d):
    return relational.contexts(_past(spark, d)).select("context_len", "store", "idx", "sales")


@query("SELECT context_len, count(*) AS series, round(avg(wql), 6) AS mean_wql, round(quantile_cont(wql, 0.5), 6) AS median_wql FROM context_wql GROUP BY context_len")
def b22_wql_by_context(spark, d):
    summary, _ = evaluate.wql_summary(runs.scored_contexts(_series(spark, d)))
    return summary.withColumns({c: F.round(c, 6) for c in ("mean_wql", "median_wql")})


@query("""SELECT c.context_len, series_id, wql, (wql > l.high)::BIGINT AS is_outlier FROM context_wql c
  JOIN (SELECT context_len, quantile_cont(wql, 0.75) + 1.5::DOUBLE * (quantile_cont(wql, 0.75) - quantile_cont(wql, 0.25)) AS high FROM context_wql GROUP BY context_len) l ON c.context_len = l.context_len""")
def b23_wql_outliers(spark, d):
    return relational.outliers(runs.scored_contexts(_series(spark, d)), "wql", ("context_len",)).select("context_len", "series_id", "wql", "is_outlier")


def _mae(spark, d) -> DataFrame:
    """MAE of the univariate forecast by series; read several times, so computed once."""
    f, truth = _scored(spark, d)
    return settled(f.join(truth, ["series_id", "step"]).groupBy("series_id").agg(F.round(evaluate.mae(F.col("y_true"), F.col("median")), 4).alias("mae")))


@query("""SELECT series_id, mae, kind, rank FROM (
  SELECT series_id, mae, 'bad' AS kind, row_number() OVER (ORDER BY mae DESC, series_id) AS rank FROM scored WHERE run = 'univariate'
  UNION ALL SELECT series_id, mae, 'good', row_number() OVER (ORDER BY mae, series_id) FROM scored WHERE run = 'univariate') WHERE rank <= 3""")
def b24_topk_worst(spark, d):
    return relational.ranked_series(_mae(spark, d), "mae", "series_id")


@query("""SELECT * FROM (
  SELECT series_id, mae, 'bad' AS kind, row_number() OVER (ORDER BY mae DESC, series_id) AS rank FROM scored WHERE run = 'univariate'
  UNION ALL SELECT series_id, mae, 'good', row_number() OVER (ORDER BY mae, series_id) FROM scored WHERE run = 'univariate') WHERE rank <= 3
  UNION ALL SELECT * FROM (SELECT series_id, mae, 'other', row_number() OVER (ORDER BY md5('42:' || series_id), series_id) AS rank FROM (
    SELECT *, row_number() OVER (ORDER BY mae DESC, series_id) AS worst, row_number() OVER (ORDER BY mae, series_id) AS best FROM scored WHERE run = 'univariate') WHERE worst > 3 AND best > 3) WHERE rank <= 5""")
def f9_selection(spark, d):
    return relational.selection(_mae(spark, d), "mae", "series_id")


@query("SELECT store, dt, year(dt) AS year, month(dt) AS month, day(dt) AS day, isodow(dt) - 1 AS day_of_week, weekofyear(dt) AS week_of_year, dayofyear(dt) AS day_of_year, (isodow(dt) >= 6)::BIGINT AS is_weekend FROM train")
def c1_c8_calendar(spark, d):
    return calendar.with_calendar(_train(spark, d).select("store", "dt"))


@query("""SELECT store, dt, coalesce(s.code, -1) AS state_holiday, coalesce(r.code, -1) AS region FROM train LEFT JOIN store_dim USING (store)
  LEFT JOIN (SELECT state_holiday, row_number() OVER (ORDER BY state_holiday) - 1 AS code FROM (SELECT DISTINCT state_holiday FROM train WHERE state_holiday IS NOT NULL)) s USING (state_holiday)
  LEFT JOIN (SELECT region, row_number() OVER (ORDER BY region) - 1 AS code FROM (SELECT DISTINCT region FROM store_dim)) r USING (region)""")
def c9_ordinal(spark, d):
    df = relational.left_join(_train(spark, d), series.store_dim(spark, d), "store").select("store", "dt", "state_holiday", "region")
    return encode.ordinal(df)


_COERCE = "CASE WHEN o_orderkey % 5 = 0 THEN 'x' || o_orderkey WHEN o_orderkey % 5 = 1 THEN NULL WHEN o_orderkey % 5 = 2 THEN ' ' || o_orderkey || ' ' WHEN o_orderkey % 5 = 3 THEN '1e3' ELSE '' END"


@query(f"SELECT o_orderkey, coalesce(TRY_CAST(trim({_COERCE}) AS DOUBLE), 0) AS number FROM orders")
def c10_coerce(spark, d):
    return series.table(spark, d, "orders").select("o_orderkey", F.expr(_COERCE).alias("t")).select("o_orderkey", encode.coerced("t").alias("number"))


@query("SELECT o_orderkey, o_totalprice::FLOAT::DOUBLE AS price FROM orders")
def c11_float32(spark, d):
    return series.table(spark, d, "orders").select("o_orderkey", encode.as_float32("o_totalprice").cast("double").alias("price"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 4 = 1 THEN 3.4028234663852886e38::DOUBLE WHEN o_orderkey % 4 = 2 THEN -3.4028234663852886e38::DOUBLE ELSE o_totalprice END AS price FROM orders""")
def c12_scrub(spark, d):
    raw = F.expr("CASE WHEN o_orderkey % 8 = 0 THEN double('NaN') WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN double('Infinity') WHEN o_orderkey % 4 = 2 THEN double('-Infinity') ELSE o_totalprice END")
    return series.table(spark, d, "orders").select("o_orderkey", encode.scrubbed(raw).alias("price"))


@query("SELECT store, idx, printf('%.4f', abs(sales)) AS absolute, printf('%.4f', sqrt(sales * sales)) AS root, greatest(sales, 0) AS positive FROM series")
def c13_c15_format(spark, d):
    s = F.col("sales")
    return _series_once(spark, d).select("store", "idx", encode.four_places(F.abs(s)).alias("absolute"), encode.four_places(F.sqrt(s * s)).alias("root"), F.greatest(s, F.lit(0.0)).alias("positive"))


@query("SELECT store, dt, promo * open AS promo_effect FROM train")
def c16_promo_effect(spark, d):
    return _train(spark, d).select("store", "dt", calendar.promo_effect().alias("promo_effect"))


@query("""SELECT store, dt, (CASE WHEN flag = 1 THEN 0 ELSE least(sum((flag <> 1)::INT) OVER (PARTITION BY store, island ORDER BY dt), 30) END)::BIGINT AS closed_run
  FROM (SELECT *, sum((flag = 1)::INT) OVER (PARTITION BY store ORDER BY dt) AS island FROM flagged)""")
def c17_closed_run(spark, d):
    return calendar.closed_run(_flags(spark, d), is_open="flag").select("store", "dt", "closed_run")


@query("""SELECT store, dt, coalesce(least(first_value(CASE WHEN flag = 1 THEN dt END IGNORE NULLS) OVER (PARTITION BY store ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - dt, 30), 30)::BIGINT AS days_to_open FROM flagged""")
def c18_next_open(spark, d):
    return calendar.days_to_open(_flags(spark, d), is_open="flag").select("store", "dt", "days_to_open")


@query("SELECT store, dt, CASE WHEN open IS NOT NULL THEN open::VARCHAR END AS open_cat FROM train")
def c19_open_cat(spark, d):
    return _train(spark, d).select("store", "dt", F.col("open").cast("string").alias("open_cat"))


@query("SELECT f.series_id, step, p10 * promo AS p10, median * promo AS median, p90 * promo AS p90 FROM naive f JOIN test ON test.store = f.series_id AND test.idx = f.step")
def c20_gated(spark, d):
    past, test = relational.split(_series(spark, d))
    return relational.gated(forecast.seasonal_naive(past), test.select(F.col("store").alias("series_id"), F.col("idx").alias("step"), F.col("promo").alias("open")))



@query(f"SELECT store, idx, round({_normal('noise')}, 6) AS noise_random FROM series")
def d1_noise(spark, d):
    return perturb.noise(_series_once(spark, d)).select("store", "idx", F.round("noise_random", 6).alias("noise_random"))


@query("SELECT store, idx, " + ", ".join(f"round({c} + 10 * {_normal(c)}, 8) AS {c}" for c in ("customers", "promo", "school_holiday")) + " FROM series")
def d2_strong_noise(spark, d):
    names = ["customers", "promo", "school_holiday"]
    return perturb.strong_noise(_series_once(spark, d), names).select("store", "idx", *[F.round(c, 8).alias(c) for c in names])


@query("SELECT store, idx, promo FROM shuffled")
def d3_shuffle(spark, d):
    return perturb.shuffled(_series(spark, d)).select("store", "idx", "promo")


@query("SELECT store, idx, CASE WHEN idx >= n - 30 THEN 0 ELSE school_holiday END AS school_holiday FROM series")
def d4_missing_future(spark, d):
    return perturb.missing_future(_series_once(spark, d)).select("store", "idx", F.col("school_holiday").cast("long").alias("school_holiday"))


@query("SELECT store, idx, promo FROM shifted")
def d5_time_shift(spark, d):
    return perturb.time_shift(_series(spark, d)).select("store", "idx", "promo")


@query("SELECT store, idx, (CASE WHEN idx >= trunc(n * 0.8::DOUBLE) THEN promo * 1.5::DOUBLE ELSE promo END)::DOUBLE AS promo FROM series")
def d6_trend_break(spark, d):
    return perturb.trend_break(_series_once(spark, d)).select("store", "idx", "promo")


@query("SELECT store, dt, sales, open, state_holiday, customers, idx FROM series")
def d7_feature_drop(spark, d):
    return perturb.feature_drop(_series_once(spark, d))


@query("SELECT store, idx, " + ", ".join(f"(CASE WHEN idx >= trunc(n * (1::DOUBLE - 0.3::DOUBLE)) THEN 0 ELSE {c} END)::DOUBLE AS {c}" for c in ("customers", "open", "promo", "school_holiday")) + " FROM series")
def d8_partial_mask(spark, d):
    return perturb.partial_mask(_series_once(spark, d)).select("store", "idx", "customers", "open", "promo", "school_holiday")


@query("SELECT store, idx, " + ", ".join(f"{c} * 2::DOUBLE AS {c}" for c in ("customers", "open", "promo", "school_holiday")) + " FROM series")
def d9_scaling(spark, d):
    return perturb.scaling(_series_once(spark, d)).select("store", "idx", "customers", "open", "promo", "school_holiday")


@query("SELECT series_id, step, p10, median, p90 FROM naive")
def d10_long_horizon(spark, d):
    return runs.forecast_runs(_series(spark, d), only=("long_horizon",)).drop("run")


@query("SELECT run, series_id, step, p10, median, p90 FROM forecasts")
def d_forecast_runs(spark, d):
    return runs.forecast_runs(_series(spark, d))


_LOSS = {c: f"greatest({q}::DOUBLE * (y_true - {c}), ({q}::DOUBLE - 1) * (y_true - {c}))" for c, q in evaluate.QUANTILES}


@query("SELECT series_id, step, " + ", ".join(f"round({x}, 6) AS loss_{c}" for c, x in _LOSS.items()) + " FROM naive JOIN truth USING (series_id, step)")
def e1_pinball(spark, d):
    f, truth = _scored(spark, d)
    rows = f.join(truth, ["series_id", "step"])
    return rows.select("series_id", "step", *[F.round(evaluate.pinball(F.col("y_true"), F.col(c), q), 6).alias(f"loss_{c}") for c, q in evaluate.QUANTILES])


@query("SELECT run, series_id, wql FROM scored WHERE run IN ('univariate', 'covariate')")
def e2_wql(spark, d):
    rows = _series(spark, d)
    f = runs.forecast_runs(rows, only=("univariate", "covariate"))
    return f.join(_truth_of(rows), ["series_id", "step"]).groupBy("run", "series_id").agg(F.round(evaluate.wql(), 6).alias("wql"))


def _one_metric(spark, d, name, column, places: int = 4) -> DataFrame:
    f, truth = _scored(spark, d)
    return f.join(truth, ["series_id", "step"]).groupBy("series_id").agg(F.round(column, places).alias(name))


@query("SELECT series_id, mae FROM scored WHERE run = 'univariate'")
def e3_mae(spark, d):
    return _one_metric(spark, d, "mae", evaluate.mae(F.col("y_true"), F.col("median")))


@query("SELECT series_id, round(avg((y_true - median) * (y_true - median)), 1) AS mse FROM naive JOIN truth USING (series_id, step) GROUP BY series_id")
def e4_mse(spark, d):
    return _one_metric(spark, d, "mse", evaluate.mse(F.col("y_true"), F.col("median")), 1)


@query("SELECT series_id, round(sqrt(avg((y_true - median) * (y_true - median))), 4) AS rmse FROM naive JOIN truth USING (series_id, step) GROUP BY series_id")
def e5_rmse(spark, d):
    return _one_metric(spark, d, "rmse", evaluate.rmse(F.col("y_true"), F.col("median")))


@query("SELECT series_id, round(avg(p90 - p10), 4) AS width FROM naive JOIN truth USING (series_id, step) GROUP BY series_id")
def e6_width(spark, d):
    return _one_metric(spark, d, "width", evaluate.interval_width(F.col("p10"), F.col("p90")))


@query("SELECT series_id, round(100 * avg((median - y_true) / (abs(y_true) + 1e-9)), 4) AS percent FROM naive JOIN truth USING (series_id, step) GROUP BY series_id")
def e7_pct_diff(spark, d):
    return _one_metric(spark, d, "percent", evaluate.percent_difference(F.col("y_true"), F.col("median")))


_COMPARE = """round(avg(abs(base_median - median)), 4) AS mae, round(sqrt(avg((base_median - median) * (base_median - median))), 4) AS rmse,
  round(100 * avg((median - base_median) / (abs(base_median) + 1e-9)), 4) AS percent_difference, round(avg(base_p90 - base_p10), 4) AS interval_base, round(avg(p90 - p10), 4) AS interval_test"""


@query(f"SELECT run, series_id, {_COMPARE} FROM fanned GROUP BY run, series_id")
def e8_compare(spark, d):
    f, _ = _forecasts(spark, d, "covariate", *TESTS)
    out = evaluate.compare(relational.fan_out(f.filter("run = 'covariate'"), f.filter("run <> 'covariate'")))
    return out.select("run", "series_id", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


def _report_sql() -> str:
    """Lines of the report from the same aggregates, section by section."""
    wide = f"SELECT run, avg(abs(base_median - median)) AS a, sqrt(avg((base_median - median) * (base_median - median))) AS b, 100 * avg((median - base_median) / (abs(base_median) + 1e-9)) AS c, avg(base_p90 - base_p10) AS d, avg(p90 - p10) AS e FROM fanned GROUP BY run"
    first = "SELECT avg(abs(b.median - f.median)) AS a, sqrt(avg((b.median - f.median) * (b.median - f.median))) AS b, 100 * avg((f.median - b.median) / (abs(b.median) + 1e-9)) AS c, avg(b.p90 - b.p10) AS d, avg(f.p90 - f.p10) AS e FROM forecasts b JOIN forecasts f ON f.run = 'covariate' AND b.run = 'univariate' AND f.series_id = b.series_id AND f.step = b.step"
    total = "SELECT run, 2 * sum(" + " + ".join(_LOSS.values()) + ") / (sum(abs(y_true)) + 1e-9) / 3 AS w FROM forecasts JOIN truth USING (series_id, step) GROUP BY run"
    parts = [f"SELECT 0 AS line_no, '{report.TITLE}' AS line", "SELECT 1, ''"]

    def five(source: str, order: int, title: str, base: str, test: str) -> None:
        lines = [f"'> {title}'", *[f"'{n}: ' || printf('%.4f', {c})" for n, c in (("MAE", "a"), ("RMSE", "b"), ("PercentDifference", "c"), (f"Interval_{base}", "d"), (f"Interval_{test}", "e"))], "''"]
        parts.extend(f"SELECT {order * 100 + i}, {x} FROM ({source})" for i, x in enumerate(lines))

    five(first, 1, "Covariates vs Univariate", "Univariate", "Covariates")
    for order, (run, label) in enumerate((("univariate", "Univariate"), ("covariate", "Covariates")), 2):
        parts.extend(f"SELECT {order * 100 + i}, {x} FROM ({total}) WHERE run = '{run}'" for i, x in enumerate((f"'> {label} vs Ground Truth'", "'WQL: ' || printf('%.4f', w)", "''")))
    for order, run in enumerate(TESTS, 4):
        p = perturb.PERTURBATIONS[run]
        five(f"SELECT * FROM ({wide}) WHERE run = '{run}'", order, f"{p.title} vs Covariates", "Covariates", p.label)
    at = (4 + len(TESTS)) * 100
    texts = ["> Long Horizon Test", *report.LONG_TEXT]
    parts.extend(f"SELECT {at + i}, '{x}'" for i, x in enumerate(texts))
    parts.append(f"SELECT {at + 3}, 'Average prediction interval width: ' || printf('%.4f', avg(p90 - p10)) FROM forecasts WHERE run = 'long_horizon'")
    return "SELECT line_no::BIGINT AS line_no, line FROM (" + " UNION ALL ".join(parts) + ")"


@query(_report_sql())
def e10_report(spark, d):
    f, rows = _forecasts(spark, d)
    return report.build(spark, f, _truth_of(rows))


@query("""SELECT series_id, round(avg(abs(median - y_true)), 4) AS mae_all, round(avg(abs(median - y_true)) FILTER (promo = 1), 4) AS mae_open, round(avg(abs(median - y_true)) FILTER (promo = 0), 4) AS mae_closed
  FROM naive JOIN truth USING (series_id, step) JOIN test ON test.store = series_id AND test.idx = step GROUP BY series_id""")
def e12_mae_split(spark, d):
    past, test = relational.split(_series(spark, d))
    test = test.select(F.col("store").alias("series_id"), F.col("idx").alias("step"), F.col("sales").alias("y_true"), "promo")
    out = evaluate.mae_by_state(forecast.seasonal_naive(past).join(test, ["series_id", "step"]), "promo")
    return out.select("series_id", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


@query("SELECT context_len, round(avg(wql), 6) AS mean_wql FROM context_wql GROUP BY context_len ORDER BY round(avg(wql), 6), context_len LIMIT 1")
def e13_best_context(spark, d):
    _, best = evaluate.wql_summary(runs.scored_contexts(_series(spark, d)))
    return best.select("context_len", F.round("mean_wql", 6).alias("mean_wql"))


@query("SELECT series_id, step, median, p10, p90 FROM naive WHERE step < 30")
def f1_forecast(spark, d):
    return figures.forecast(_univariate(spark, d))


@query("SELECT series_id, step, median, p10, p90, y_true FROM naive JOIN truth USING (series_id, step)")
def f2_vs_truth(spark, d):
    return figures.forecast_vs_truth(*_scored(spark, d))


@query("""SELECT store AS series_id, idx - n + 90 AS x, CASE WHEN idx < n - 30 THEN 'real_past' ELSE 'real_future' END AS series, sales AS value FROM series WHERE idx >= n - 90
  UNION ALL SELECT series_id, step + 60, s, CASE s WHEN 'p10' THEN p10 WHEN 'median' THEN median ELSE p90 END FROM naive, unnest(['p10', 'median', 'p90']) AS t(s) WHERE step < 30""")
def f3_case_study(spark, d):
    rows = _series(spark, d)
    return figures.case_study(rows, forecast.seasonal_naive(relational.split(rows)[0]))


_PAIR = "FROM fanned WHERE run = 'time_shift'"


@query(f"SELECT series_id, step, base_median, median AS test_median {_PAIR}")
def f4_comparison(spark, d):
    return _pair(spark, d).select("series_id", "step", "base_median", "test_median")


@query(f"SELECT series_id, step, round(median - base_median, 6) AS difference {_PAIR}")
def f5_difference(spark, d):
    return _pair(spark, d).select("series_id", "step", F.round("difference", 6).alias("difference"))


@query(f"SELECT series_id, step, round(100 * (median - base_median) / (abs(base_median) + 1e-6), 6) AS percent {_PAIR}")
def f6_pct_series(spark, d):
    return _pair(spark, d).select("series_id", "step", F.round("percent", 6).alias("percent"))


@query("SELECT series_id, step, round(p90 - p10, 6) AS width FROM naive WHERE step < 30")
def f7_uncertainty(spark, d):
    out = figures.uncertainty(_univariate(spark, d))
    return out.withColumn("width", F.round("width", 6))


_OF = "CASE s WHEN 'median' THEN median WHEN 'p10' THEN p10 WHEN 'p90' THEN p90 {} END"


@query(f"""SELECT figure, series, count(*) AS points, sum(round(y * 100)::BIGINT)::BIGINT AS total, sum(round(y * 100)::BIGINT * (x + series_id))::BIGINT AS weighted FROM (
  SELECT 'forecast_' || run AS figure, s AS series, series_id, step AS x, {_OF.format('')} AS y FROM forecasts, unnest(['median', 'p10', 'p90']) AS t(s) WHERE run IN ('univariate', 'covariate', 'long_horizon')
  UNION ALL SELECT 'truth_' || run, s, series_id, step, {_OF.format("WHEN 'y_true' THEN y_true")} FROM forecasts JOIN truth USING (series_id, step), unnest(['median', 'p10', 'p90', 'y_true']) AS t(s) WHERE run IN ('univariate', 'covariate')
  UNION ALL SELECT 'case_' || r, CASE WHEN idx < n - 30 THEN 'real_past' ELSE 'real_future' END, store, idx - n + 90, sales FROM series, unnest(['univariate', 'covariate']) AS t(r) WHERE idx >= n - 90
  UNION ALL SELECT 'case_' || run, s, series_id, step + 60, {_OF.format('')} FROM forecasts, unnest(['median', 'p10', 'p90']) AS t(s) WHERE run IN ('univariate', 'covariate') AND step < 30
  UNION ALL SELECT 'compare_' || run, s, series_id, step, {_OF.format("WHEN 'base_median' THEN base_median WHEN 'difference' THEN median - base_median ELSE 100 * (median - base_median) / (abs(base_median) + 1e-6)")}
    FROM fanned, unnest(['base_median', 'median', 'difference', 'percent']) AS t(s)
  UNION ALL SELECT 'width_' || run, 'width', series_id, step, p90 - p10 FROM forecasts WHERE run IN ('covariate', 'missing_future', 'scaling')) GROUP BY 1, 2""")
def f8_figures(spark, d):
    f, rows = _forecasts(spark, d)
    cents = F.round(F.col("y") * 100).cast("long")
    return figures.all_figures(rows, f, _truth_of(rows)).groupBy("figure", "series").agg(F.count("*").alias("points"), F.sum(cents).alias("total"), F.sum(cents * (F.col("x") + F.col("series_id"))).alias("weighted"))


@query("SELECT series_id, step, p10, median, p90 FROM naive WHERE step < 30")
def g4_univariate(spark, d):
    return _univariate(spark, d)


@query("SELECT series_id, step, p10, median, p90 FROM forecasts WHERE run = 'covariate'")
def g5_covariates(spark, d):
    past, test = relational.split(_series(spark, d))
    return forecast.covariate_naive(past, test, runs.COVARIATES, observed=("customers", "open"))


_LISTED = "md5(string_agg((round({}::FLOAT::DOUBLE * 100)::BIGINT)::VARCHAR, ',' ORDER BY idx))"


@query(f"""SELECT p.store, target_n, target, past_customers, past_promo, future_n, future_promo FROM (
  SELECT store, count(*) AS target_n, {_LISTED.format('sales')} AS target, {_LISTED.format('customers')} AS past_customers, {_LISTED.format('promo')} AS past_promo FROM past GROUP BY store) p
  JOIN (SELECT store, count(*) AS future_n, {_LISTED.format('promo')} AS future_promo FROM test GROUP BY store) f USING (store)""")
def g6_tasks(spark, d):
    past, test = relational.split(_series(spark, d))
    t = forecast.tasks(past, ["customers", "promo", "school_holiday"], ["promo"], test)
    listed = lambda c: F.md5(F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 100).cast("long").cast("string")), ","))
    own, ahead = F.col("past_covariates"), F.col("future_covariates")
    return t.select("store", F.size("target").cast("long").alias("target_n"), listed(F.col("target")).alias("target"), listed(own["customers"]).alias("past_customers"), listed(own["promo"]).alias("past_promo"), F.size(ahead["promo"]).cast("long").alias("future_n"), listed(ahead["promo"]).alias("future_promo"))


@query("""SELECT past.store AS series_id, step, round(sales::FLOAT::DOUBLE + low - mid, 3) AS p10, round(sales::FLOAT::DOUBLE, 3) AS median, round(sales::FLOAT::DOUBLE + high - mid, 3) AS p90
  FROM past JOIN (SELECT store, quantile_cont(d, 0.1) AS low, quantile_cont(d, 0.5) AS mid, quantile_cont(d, 0.9) AS high, count(*) AS m FROM (
    SELECT store, sales::FLOAT::DOUBLE - lag(sales::FLOAT::DOUBLE, 7) OVER (PARTITION BY store ORDER BY idx) AS d FROM past) GROUP BY store) USING (store)
  JOIN steps ON past.idx - (m - 7) = step % 7 WHERE past.idx >= m - 7 AND step < 30""")
def g7_hosted_model(spark, d):
    task_rows = forecast.tasks(_past(spark, d), ["promo"], ["promo"])
    out = forecast.widened(forecast.hosted(task_rows, forecast.repeated_season()))
    return out.select("series_id", "step", *[F.round(c, 3).alias(c) for c in ("p10", "median", "p90")])


@query("""SELECT store, target_n AS target, target_n AS past_promo, 30 AS future_promo FROM (SELECT store, count(*) AS target_n FROM past GROUP BY store)""")
def g8_task_shapes(spark, d):
    shapes = forecast.task_shapes(forecast.tasks(_past(spark, d), ["promo"], ["promo"]))
    return shapes.select("store", F.col("target").cast("long").alias("target"), F.col("past_covariates")["promo"].cast("long").alias("past_promo"), F.col("future_covariates")["promo"].alias("future_promo"))


@query("""SELECT series, step, round(median, 3) AS median FROM (
  SELECT event_type AS series, date_trunc('hour', ts) AS h, count(*)::DOUBLE AS median, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events GROUP BY 1, 2)
  JOIN steps ON i - (c - 7) = step % 7 WHERE i >= c - 7""")
def g8_events_hourly(spark, d):
    rows = series.indexed(series.events_hourly(spark, d), "series", "ts")
    return forecast.seasonal_naive(rows, 90, "target", "series").select(F.col("series_id").alias("series"), "step", F.round("median", 3).alias("median"))


_ONE = "(ORDER BY dt, store ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_FILLED_ONE = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER {_ONE}, first_value({c} IGNORE NULLS) OVER {_ONE.replace('UNBOUNDED PRECEDING AND CURRENT ROW', 'CURRENT ROW AND UNBOUNDED FOLLOWING')}) AS {c}" for c in ("sales", "open", "promo", "school_holiday", "state_holiday", "customers"))


@query(f"SELECT store, dt, {_FILLED_ONE}, row_number() OVER (ORDER BY dt, store) - 1 AS idx FROM train")
def b5_single_series(spark, d):
    """The whole table as one series, filled in many tasks."""
    return relational.fill_both(_train(spark, d), None, ("dt", "store"))


@query(f"SELECT {RAW}, row_number() OVER (ORDER BY dt, store) - 1 AS idx FROM train QUALIFY row_number() OVER (ORDER BY dt DESC, store DESC) > 30")
def b7_single_past(spark, d):
    return relational.split(_train(spark, d), 30, None, ("dt", "store"))[0]


@query("""SELECT a.store, a.dt, b.promo, a.idx FROM (SELECT *, row_number() OVER (ORDER BY dt, store) - 1 AS idx FROM train) a
  JOIN (SELECT promo, (row_number() OVER (ORDER BY dt, store) - 1 + 7) % count(*) OVER () AS idx FROM train) b USING (idx)""")
def d5_single_shift(spark, d):
    return single.time_shift(single.place(_train(spark, d).select("store", "dt", "promo"), ("dt", "store")))


@query("""SELECT f.series_id, f.step, f.dt, f.median, CASE WHEN f.dt - t.dt <= 2 THEN t.dt END AS matched_dt, CASE WHEN f.dt - t.dt <= 2 THEN t.sales END AS matched_sales
  FROM (SELECT n.series_id, n.step, n.median, (l.dt + (1 + n.step)::INT)::DATE AS dt FROM naive n JOIN (SELECT store, max(dt) AS dt FROM past GROUP BY store) l ON l.store = n.series_id) f
  ASOF LEFT JOIN (SELECT store AS series_id, dt, sales FROM test) t ON f.series_id = t.series_id AND f.dt >= t.dt""")
def b25_asof_join(spark, d):
    """Forecasts by calendar day with the last true value at or before it, two days back at most."""
    past, test = relational.split(_series(spark, d))
    began = past.groupBy(F.col("store").alias("series_id")).agg(F.max("dt").alias("__began"))
    f = forecast.seasonal_naive(past, 90).join(began, "series_id").select("series_id", "step", F.date_add(F.date_add("__began", 1), F.col("step").cast("int")).alias("dt"), "median")
    return timed.asof_join(f, test.select(F.col("store").alias("series_id"), "dt", "sales"), "dt", ["series_id"], tolerance=2)


_RUNS = """(SELECT store, min(dt) AS first, max(dt) AS last, count(*) AS days FROM (
    SELECT store, dt, dt - (row_number() OVER (PARTITION BY store ORDER BY dt))::INT AS island FROM flagged WHERE flag = 0) GROUP BY store, island)"""


@query(f"""SELECT o.o_orderkey, o.store, o.dt, r.first AS matched_first, r.last AS matched_last, r.days AS matched_days
  FROM (SELECT o_orderkey, c_nationkey::BIGINT AS store, o_orderdate::DATE AS dt FROM orders JOIN customer ON o_custkey = c_custkey) o
  JOIN {_RUNS} r ON o.store = r.store AND o.dt BETWEEN r.first AND r.last""")
def b26_range_join(spark, d):
    """Orders that came in while their store was closed, with the run of closed days."""
    customer = series.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("store"))
    orders = series.table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "store", F.col("o_orderdate").cast("date").alias("dt"))
    closed = timed.runs_of(_flags(spark, d).select("store", "dt", "flag"), F.col("flag") == 0)
    return timed.range_join(orders, closed, "dt", ("first", "last"), ["store"])


@query(f"""SELECT a.store, a.first, a.last, a.days, b.store AS matched_store, b.first AS matched_first, b.last AS matched_last, b.days AS matched_days
  FROM {_RUNS} a JOIN {_RUNS} b ON a.first <= b.last AND b.first <= a.last WHERE a.days >= 3 AND b.days >= 3 AND a.store <> b.store""")
def b27_interval_join(spark, d):
    """Runs of three closed days or more of different stores that overlap."""
    closed = settled(timed.runs_of(_flags(spark, d).select("store", "dt", "flag"), F.col("flag") == 0).filter("days >= 3"))
    return timed.overlap_join(closed, closed, ("first", "last"), ("first", "last")).filter("store <> matched_store")


_LEVELS = (("run", "context_len"), ("run", "region"), ("run", "store"), ("region",), ())


@query("""SELECT run, context_len::BIGINT AS context_len, region, store, grouping_id(run, context_len, region, store)::BIGINT AS grouping_id, count(*) AS steps,
  round(2 * sum(""" + " + ".join(f"greatest({q}::DOUBLE * (y_true - {c}), ({q}::DOUBLE - 1) * (y_true - {c}))" for c, q in evaluate.QUANTILES) + """) / (sum(abs(y_true)) + 1e-9) / 3, 6) AS wql, round(avg(abs(y_true - median)), 3) AS mae
  FROM (SELECT run, 0 AS context_len, series_id AS store, step, p10, median, p90 FROM forecasts WHERE run IN ('univariate', 'covariate', 'time_shift') AND step < 30
    UNION ALL SELECT 'univariate', context_len, series_id, step, p10, median, p90 FROM context_forecast) f
  JOIN (SELECT series_id AS store, step, y_true FROM truth) t USING (store, step) JOIN store_dim USING (store)
  GROUP BY GROUPING SETS ((run, context_len), (run, region), (run, store), (region), ())""")
def e15_score_levels(spark, d):
    """Scores by run and context, region, store, by region and in all, from one aggregate; context 0 is the whole past."""
    rows = _series(spark, d)
    past, test = relational.split(rows)
    whole = runs.forecast_runs(rows, only=("univariate", "covariate", "time_shift")).withColumn("context_len", F.lit(0).cast("long"))
    cut = runs.context_forecasts(past).withColumn("run", F.lit("univariate"))
    both = whole.unionByName(cut).join(runs.truth(test), ["series_id", "step"]).withColumnRenamed("series_id", "store")
    out = evaluate.score_levels(both.join(series.store_dim(spark, d).select("store", "region"), "store"), _LEVELS)
    return out.withColumns({"wql": F.round("wql", 6), "mae": F.round("mae", 3), "grouping_id": F.col("grouping_id").cast("long")})


@query("""SELECT past.store AS series_id, step, round(sales + low, 6) AS p10, round(sales, 6) AS median, round(sales + high, 6) AS p90
  FROM past JOIN (SELECT store, quantile_disc(d, 0.1) AS low, quantile_disc(d, 0.9) AS high FROM (SELECT store, sales - lag(sales, 7) OVER (PARTITION BY store ORDER BY idx) AS d FROM past) GROUP BY store) USING (store)
  JOIN (SELECT store, count(*) AS m FROM past GROUP BY store) USING (store) JOIN steps ON past.idx - (m - 7) = step % 7 WHERE past.idx >= m - 7 AND step < 30""")
def e16_sketch_forecast(spark, d):
    """The seasonal forecast with bounds from quantile sketches kept per month and merged."""
    past = _past(spark, d)
    kept = settled(sketches.residual_sketches(past))
    return sketches.forecast_from(relational.tail(past, 7).select("store", "step", "sales"), kept)


@query("""SELECT event_type, count(DISTINCT user_id) AS users, 1::BIGINT AS within FROM events GROUP BY event_type""")
def e17_distinct_sketches(spark, d):
    """Users of each event type: the exact number, and whether the estimate from daily sketches lies within its error of that."""
    events = series.table(spark, d, "events").select("event_type", "user_id", F.col("ts").cast("date").alias("day"))
    estimate = sketches.merged_distinct(sketches.distinct_sketches(events, "user_id", ["event_type", "day"]), ["event_type"])
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    off = F.abs(F.col("distinct") - F.col("users")) / F.col("users")
    return exact.join(estimate, "event_type").select("event_type", "users", (off <= 3 * 1.04 / 2 ** (sketches.BITS / 2)).cast("long").alias("within"))


@query("""SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS events, (sum(round(value * 1000)::BIGINT)::BIGINT)::DOUBLE / 1000::DOUBLE AS amount FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM (
    SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR IS NOT TRUE)::INT AS fresh FROM events)) GROUP BY user_id, nth""")
def h1_sessions(spark, d):
    out = sessions.sessions(series.table(spark, d, "events"), gap="6 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "last")})


@query(SQL["g7_hosted_model"].partition("SELECT past.store AS series_id")[1] + SQL["g7_hosted_model"].partition("SELECT past.store AS series_id")[2])
def g9_table_function(spark, d):
    """The hosted model as a table function in SQL."""
    table.register_forecast(spark, forecast.repeated_season())
    _past(spark, d).createOrReplaceTempView("past_rows")
    out = spark.sql("SELECT * FROM forecast(TABLE(SELECT store, idx, sales FROM past_rows) PARTITION BY store ORDER BY idx)")
    return out.select("series_id", "step", *[F.round(c, 3).alias(c) for c in ("p10", "median", "p90")])


@query("""SELECT series, day, hours, coalesce(orders, 0) AS orders, (hours - coalesce(taken, 0))::BIGINT AS gaps FROM (
  SELECT series, day, epoch(((day + 1)::TIMESTAMP AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC' - (day::TIMESTAMP AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC') / 3600 AS hours FROM (
    SELECT series, unnest(range(min(day)::TIMESTAMP, max(day)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM zoned_orders GROUP BY series))
  LEFT JOIN (SELECT series, day, count(*) AS orders, count(DISTINCT date_trunc('hour', ts)) AS taken FROM zoned_orders GROUP BY 1, 2) USING (series, day)""".replace("zoned_orders", """(
    SELECT r_name AS series, ts, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin')::DATE AS day FROM (
      SELECT o_custkey, o_orderdate::TIMESTAMP + to_hours((o_orderkey % 24)::INT) AS ts FROM orders)
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""))
def b28_local_days(spark, d):
    """Orders by region and day of a zone whose clock changes, with the day's length in hours and its hours without orders; an order's hour is made from its key."""
    nation = series.table(spark, d, "nation").join(series.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("series"))
    placed = series.table(spark, d, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "series")
    at = F.col("o_orderdate").cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    orders = series.table(spark, d, "orders").select("o_custkey", at.alias("ts")).join(placed, F.col("o_custkey") == F.col("c_custkey"))
    hourly = zoned.with_local_hour(orders.select("series", "ts"), "Europe/Berlin").groupBy("series", "day", "hour").agg(F.count("*").alias("orders"))
    every = zoned.local_hours(hourly, "Europe/Berlin", "series")
    return every.groupBy("series", "day").agg(F.first("hours").alias("hours"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.sum("is_gap").alias("gaps"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WQL of the seasonal model per series, for series long enough to split."""
    past, test = relational.split(runs.processed(spark, sf_dir, 37))
    return forecast.seasonal_naive(past).join(runs.truth(test), ["series_id", "step"]).groupBy("series_id").agg(F.round(evaluate.wql(), 6).alias("wql"))
