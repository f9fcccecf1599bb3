"""Edge cases and properties of single operators."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater.functions import calendar, encode
from tidewater.operators import evaluate, forecast, perturb, relational
from tidewater.plans import report
from tidewater.sources import files


def frame(spark, n, key=1, **columns):
    rows = [(key, i, float(i), *[f(i) for f in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(["store long", "idx long", "sales double", *[f"{c} long" for c in columns]]))


def values(df, column, order="idx"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_left_join_keys(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    dim = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k long, v string")
    out = relational.left_join(fact, dim, "k")
    assert out.columns == ["k", "v_x", "v_y"]
    assert sorted((r.v_x, r.v_y or "") for r in out.collect()) == [("a", "x"), ("a", "y"), ("b", ""), ("c", "")]
    assert ("c", "z") in {(r.v_x, r.v_y) for r in relational.left_join(fact, dim, "k", match_nulls=True).collect()}


def test_fills(spark):
    df = spark.createDataFrame([(1, i, v, None) for i, v in enumerate([None, 1, None, 3, None])], "store long, dt long, v long, w long")
    assert values(relational.forward_fill(df), "v", "dt") == [None, 1, 1, 3, 3]
    both = relational.fill_both(df)
    assert values(both, "v", "dt") == [1, 1, 1, 3, 3]
    assert values(relational.fill_zero(both), "w", "dt") == [0] * 5


def test_split(spark):
    past, test = relational.split(frame(spark, 31))
    assert past.count() == 1 and values(test, "idx") == list(range(30)) and values(test, "sales")[0] == 1.0
    with pytest.raises(PySparkException, match="too small"):
        relational.split(frame(spark, 30))[0].collect()


def test_step_join_lengths(spark):
    a = spark.createDataFrame([(1, i, 1.0) for i in range(30)], "series_id long, step long, median double")
    b = spark.createDataFrame([(1, i, 1.0) for i in range(90)], "series_id long, step long, y_true double")
    with pytest.raises(PySparkException, match="Length mismatch: 30 and 90"):
        relational.by_step(a, b).collect()
    assert relational.by_step(a, b, strict=False).count() == 0


def test_calendar(spark):
    days = [dt.date(2015, 1, 1), dt.date(2016, 1, 3), dt.date(2012, 12, 31), dt.date(2015, 7, 31), dt.date(2016, 2, 29)]
    rows = calendar.with_calendar(spark.createDataFrame([(d,) for d in days], "dt date")).collect()
    assert [(r.day_of_week, r.week_of_year, r.day_of_year) for r in rows] == [(3, 1, 1), (6, 53, 3), (0, 1, 366), (4, 31, 212), (0, 9, 60)]
    with pytest.raises(PySparkException):
        calendar.with_calendar(spark.createDataFrame([("no date",)], "dt string")).collect()


def test_encodings(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["b", None, "a", "0", "B", "b"])], "i long, x string")
    assert values(encode.ordinal(df), "x", "i") == [3, -1, 2, 0, 1, 3]
    texts = ["1", " 2 ", "x", "1e3", "0x10", "True", "inf", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string")
    assert values(df.withColumn("y", encode.coerced("x")), "y", "i") == [1, 2, 0, 1000, 0, 0, math.inf, 0, 0]
    df = spark.createDataFrame([(0, math.nan), (1, math.inf), (2, -math.inf), (3, None)], "i long, x double")
    assert values(df.withColumn("y", encode.scrubbed("x")), "y", "i") == [0, encode.FLOAT_MAX, -encode.FLOAT_MAX, 0]


def test_perturbations(spark):
    df = frame(spark, 10, promo=lambda i: i, school_holiday=lambda i: 1)
    assert values(perturb.time_shift(df), "promo") == [3, 4, 5, 6, 7, 8, 9, 0, 1, 2]
    back = perturb.time_shift(perturb.time_shift(df), shift=3)
    assert values(back, "promo") == list(range(10))
    mixed = values(perturb.shuffled(df), "promo")
    assert sorted(mixed) == list(range(10)) and mixed != list(range(10)) and mixed == values(perturb.shuffled(df), "promo")
    assert values(perturb.missing_future(df, horizon=4), "school_holiday") == [1] * 6 + [0] * 4
    assert values(perturb.trend_break(df), "promo") == [0, 1, 2, 3, 4, 5, 6, 7, 12, 13.5]
    assert perturb.feature_drop(df).columns == ["store", "idx", "sales"]
    assert values(perturb.scaling(df), "promo") == [2.0 * i for i in range(10)]
    for broken in (perturb.shuffled, perturb.time_shift, perturb.missing_future, perturb.trend_break):
        with pytest.raises(ValueError):
            broken(df.drop("promo", "school_holiday"))


@pytest.mark.parametrize(("n", "start"), [(90, 62), (170, 118), (100, 70)])
def test_mask_start(spark, n, start):
    out = perturb.partial_mask(frame(spark, n, promo=lambda i: 1))
    assert values(out, "promo").index(0.0) == start and values(out, "sales") == [float(i) for i in range(n)]


def test_noise_is_normal(spark):
    got = perturb.noise(frame(spark, 5000)).agg(F.avg("noise_random").alias("m"), F.stddev("noise_random").alias("s")).first()
    assert abs(got.m) < 0.06 and abs(got.s - 1) < 0.05


def test_perfect_forecast(spark):
    df = spark.createDataFrame([(float(i), float(i), float(i), float(i)) for i in range(30)], "y_true double, p10 double, median double, p90 double")
    assert df.agg(evaluate.wql().alias("w")).first().w == 0


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(10.0, 8.0), (20.0, 26.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.agg(evaluate.mae(a, b), evaluate.mse(a, b), evaluate.rmse(a, b), evaluate.interval_width(a, b), evaluate.percent_difference(a, b)).first()
    assert [round(x, 6) for x in got] == [4, 20, round(math.sqrt(20), 6), 2, 5]


def test_seasonal_naive(spark):
    rows = forecast.seasonal_naive(frame(spark, 20), 10).orderBy("step").collect()
    assert [r["median"] for r in rows] == [13, 14, 15, 16, 17, 18, 19, 13, 14, 15] and all(r.p10 == r["median"] + 7 for r in rows)


def test_runs_of_closed_days(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    df = spark.createDataFrame([(1, day(i), x) for i, x in enumerate([1, 0, 0, 1, 0])], "store long, dt date, open long")
    assert values(calendar.closed_run(df), "closed_run", "dt") == [0, 1, 2, 0, 1]
    assert values(calendar.days_to_open(df, cap=9), "days_to_open", "dt") == [0, 2, 1, 0, 9]


def test_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("p10,median,p90\n1,2,3\n")
    (tmp_path / "e.csv").write_text("p10,median,p90\n")
    assert files.read_optional(spark, f"{tmp_path}/f.csv").first()["median"] == 2
    assert files.read_optional(spark, f"{tmp_path}/e.csv") is None
    with pytest.warns(UserWarning, match="missing"):
        assert files.read_optional(spark, f"{tmp_path}/none.csv") is None
    (tmp_path / "t.csv").write_text("Store,Date,Sales,Extra\n1,2020-01-01,,q\n")
    row = files.read_csv(spark, f"{tmp_path}/t.csv", files.FACT).first()
    assert row.Sales is None and row.Store == 1 and row.Extra == "q" and row.Open is None
    made = spark.createDataFrame([("a", 1, 0, 1.0), ("b", 1, 0, 2.0)], "run string, series_id long, step long, median double")
    files.write_forecasts(made, f"{tmp_path}/out")
    assert files.read_forecasts(spark, f"{tmp_path}/out").count() == 2
    wanted = spark.createDataFrame([("a",), ("c",)], "run string")
    assert [r.run for r in files.not_yet_written(wanted, made, ["run"]).collect()] == ["c"]


def test_report_leaves_out_missing_runs(spark):
    f = spark.createDataFrame([("univariate", 1, 0, 1.0, 2.0, 3.0)], "run string, series_id long, step long, p10 double, median double, p90 double")
    t = spark.createDataFrame([(1, 0, 2.0)], "series_id long, step long, y_true double")
    lines = [r.line for r in report.build(spark, f, t).orderBy("line_no").collect()]
    assert lines[:2] == [report.TITLE, ""] and "> Univariate vs Ground Truth" in lines and not any("Noise" in x for x in lines)
    files_path = None
    with pytest.raises(ValueError):
        report.build(spark, f, files_path)
