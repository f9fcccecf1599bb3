"""From CSV files to forecasts and a report, and the parts of it that no query shows."""

import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tidewater import batch
from tidewater.functions import calendar
from tidewater.operators import forecast, relational
from tidewater.plans import report, runs
from tidewater.plans.settle import removed_after, settled, shared_folder
from tidewater.sources import files


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    """Three stores of 150, 150 and 20 open days and some closed ones."""
    folder, rng = tmp_path_factory.mktemp("raw"), random.Random(1)
    lines = ["Store,Date,Sales,Open,Promo,SchoolHoliday,StateHoliday,Customers"]
    for store, days in ((1, 170), (2, 165), (3, 20)):
        for i in range(days):
            day, promo, school = dt.date(2020, 1, 1) + dt.timedelta(i), rng.randrange(2), rng.choice(["0", "1", ""])
            closed = i % 17 == 16
            lines.append(f"{store},{day},{'' if i % 40 == 39 else 0 if closed else 100 + 50 * promo + rng.randrange(20)},{int(not closed)},{promo},{school},{rng.choice('0ab')},{rng.randrange(5, 60)}")
    (folder / "facts.csv").write_text("\n".join(lines) + "\n")
    (folder / "stores.csv").write_text("Store,StoreType,Distance\n1,c,10.5\n2,a,\n3,a,7\n")
    return f"{folder}/facts.csv", f"{folder}/stores.csv"


def test_batch(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    batch.run(spark, *raw, out)
    processed = files.read_processed(spark, f"{out}/processed")
    assert {r.store for r in processed.select("store").distinct().collect()} == {1, 2}
    assert {"year", "week_of_year", "is_weekend", "StoreType", "Distance", "idx"} <= set(processed.columns)
    kinds = dict(processed.dtypes)
    assert kinds["state_holiday"] == kinds["StoreType"] == "bigint" and not any(k == "string" for k in kinds.values())
    assert processed.filter("open <> 1 or sales is null or school_holiday is null or Distance is null").isEmpty()
    truth = spark.read.parquet(f"{out}/ground_truth")
    assert truth.columns == ["series_id", "step", "y_true"] and truth.count() == 60
    found = files.read_forecasts(spark, f"{out}/forecasts")
    sizes = {r.run: r["count"] for r in found.groupBy("run").count().collect()}
    assert sizes == {r: 180 if r == "long_horizon" else 60 for r in batch.RUNS}
    lines = [x for f in sorted((tmp_path / "out" / "report").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0] == report.TITLE and sum(x.startswith("> ") for x in lines) == 13 and "> Scaling vs Covariates" in lines
    assert {f.name for f in (tmp_path / "out" / "figures").glob("figure=*")} >= {"figure=case_univariate", "figure=compare_noise", "figure=width_scaling"}
    assert spark.read.option("header", True).csv(f"{out}/plot_selection").filter("kind = 'bad'").count() == 2
    # Nothing is computed again but what is missing.
    import shutil

    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "forecasts").glob("run=*/*.parquet")}
    shutil.rmtree(tmp_path / "out" / "forecasts" / "run=noise")
    assert batch.missing_runs(spark, f"{out}/forecasts") == ["noise"]
    batch.run(spark, *raw, out, skip_existing=True)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "forecasts").glob("run=*/*.parquet")}
    assert all(after[f] == t for f, t in before.items() if "run=noise" not in str(f)) and any("run=noise" in str(f) for f in after)


def test_processed_files_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "store long, name string, sales double")
    for fmt in ("parquet", "csv"):
        files.write_processed(df, f"{tmp_path}/{fmt}", fmt)
        assert sorted(r.sales or 0 for r in files.read_processed(spark, f"{tmp_path}/{fmt}", "sales", fmt=fmt).collect()) == [0, 2.5]
    plan = files.read_processed(spark, f"{tmp_path}/parquet", "sales")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<sales:double>" in plan


def test_forecasts_by_context_and_series(spark, tmp_path):
    df = spark.createDataFrame([(128, 1, 0, 1.0), (128, 2, 0, 2.0), (256, 1, 0, 3.0)], "context_len long, series_id long, step long, median double")
    files.write_forecasts(df, f"{tmp_path}/f", "context_len", "series_id")
    assert (tmp_path / "f" / "context_len=256" / "series_id=1").is_dir()
    assert [r["median"] for r in files.read_forecasts(spark, f"{tmp_path}/f").filter("context_len = 128 and series_id = 2").collect()] == [2.0]


def frame(spark, n=150, stores=2):
    rng = random.Random(3)
    rows = [(s, i, 100.0 + 40 * (p := rng.randrange(2)) + rng.randrange(9), rng.randrange(5, 60), 1, p, rng.randrange(2)) for s in range(stores) for i in range(n)]
    return settled(spark.createDataFrame(rows, "store long, idx long, sales double, customers long, open long, promo long, school_holiday long"))


def test_every_perturbed_run_has_forecasts_of_its_own(spark):
    rows = frame(spark)
    got = {}
    for r in runs.forecast_runs(rows).filter("step < 30").collect():
        got.setdefault(r.run, {})[r.series_id, r.step] = round(r["median"], 4)
    assert set(got) == set(batch.RUNS) and all(len(x) == 60 for x in got.values())
    assert got["long_horizon"] == got["univariate"]
    different = [tuple(sorted(x.items())) for run, x in got.items() if run != "long_horizon"]
    assert len(set(different)) == len(different)
    some = runs.forecast_runs(rows, only=("scaling",)).collect()
    assert {r.run for r in some} == {"scaling"} and {(r.series_id, r.step): round(r["median"], 4) for r in some} == got["scaling"]
    with pytest.raises(ValueError):
        runs.forecast_runs(rows, only=("none",))


def test_origins(spark):
    rows = frame(spark)
    full = {(r.series_id, r.step): r["median"] for r in runs.forecast_runs(rows, only=("univariate",), origin="full").collect()}
    last = {(r.store, r.idx): r.sales for r in rows.collect()}
    assert all(full[s, k] == last[s, 143 + k % 7] for s, k in full) and len(full) == 60
    assert runs.forecast_runs(rows, only=("covariate", "time_shift"), origin="full").count() == 120
    with pytest.raises(ValueError):
        runs.forecast_runs(rows, origin="elsewhere")


def test_covariates_by_hand(spark):
    """Effect 10 of a flag that is on half of the time: days without it gain half of it, and a known future all of it."""
    rows = spark.createDataFrame([(1, i, 100.0 + 10 * (i % 2), i % 2) for i in range(28)], "store long, idx long, sales double, promo long")
    ahead = spark.createDataFrame([(1, i, 1) for i in range(5)], "store long, idx long, promo long")
    known = [r["median"] for r in forecast.covariate_naive(rows, ahead, ["promo"], 7).orderBy("step").collect()]
    assert known[:5] == [110.0] * 5 and known[5:] == [105.0] * 2
    observed = [r["median"] for r in forecast.covariate_naive(rows, ahead, [], 7, observed=["promo"]).collect()]
    assert observed == [105.0] * 7


def test_models_loaded_by_name(spark, tmp_path):
    (tmp_path / "stub_model.py").write_text("import numpy as np\n\ndef make(add):\n    def predict(target, past, future, horizon, levels):\n        return np.array([[target[-1] + add + q] * horizon for q in levels])\n    return predict\n")
    spark.sparkContext.addPyFile(str(tmp_path / "stub_model.py"))
    tasks = forecast.tasks(frame(spark, 40, 1), ["promo"], ["promo"])
    got = forecast.widened(forecast.hosted(tasks, forecast.pretrained("stub_model:make", 1000), 4)).collect()
    assert len(got) == 4 and all(r["median"] > 1100 and round(r.p90 - r.p10, 3) == 0.8 for r in got)
    shapes = forecast.task_shapes(tasks).first()
    assert shapes.target == 40 and shapes.past_covariates == {"promo": 40} and shapes.future_covariates == {"promo": 30}


def test_no_frame_looks_ahead(spark):
    """Frames that end with the partition make a window quadratic in a series."""
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1.0, 1)], "store long, dt date, sales double, open long")
    for out in (relational.fill_both(df), relational.validity(df), calendar.days_to_open(df)):
        assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower().replace("unboundedpreceding$(), unboundedfollowing$()", "")


def test_long_series_are_filled_fast(spark):
    import time

    df = spark.range(60000).select(F.lit(1).alias("store"), F.col("id").alias("dt"), F.when(F.col("id") % 50000 == 49999, F.col("id")).alias("v"))
    began = time.perf_counter()
    assert relational.fill_both(df).agg(F.sum("v")).first()[0] == 60000 * 49999 and time.perf_counter() - began < 20


def test_selection(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "store long, mae double")
    got = relational.selection(df, sample=4).collect()
    of = lambda kind: [r.store for r in sorted(got, key=lambda r: r.rank) if r.kind == kind]
    assert of("bad") == [19, 18, 17] and of("good") == [0, 1, 2] and len(of("other")) == 4 and set(of("other")) <= set(range(3, 17))


def test_a_cluster_without_a_shared_folder_is_an_error(tmp_path):
    class Session:
        conf = {}

        class sparkContext:
            master, folder = "spark://host:7077", None
            getCheckpointDir = classmethod(lambda c: c.folder)

            @classmethod
            def setCheckpointDir(cls, folder):
                cls.folder = folder

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        Session.sparkContext.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(Session)
    Session.sparkContext.master = "local[4]"
    assert shared_folder(Session) == shared_folder(Session) == Session.sparkContext.folder
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert shared_folder(Session) == "hdfs://x/y"


STUB = """import numpy as np

def make():
    def predict(target, past, future, horizon, levels):
        # What a run is told shows in its forecast: the number of covariates, past and ahead.
        assert all(len(v) == len(target) for v in past.values()) and all(len(v) == horizon for v in future.values())
        return np.array([[100 * len(past) + len(future) + q + 0 * target[-1]] * horizon for q in levels])
    return predict
"""


def test_a_model_daily_series_and_contexts(spark, raw, tmp_path):
    """The command with a model by name: all runs of it, closed days kept, gated forecasts, ablation; then evaluation and figures alone."""
    (tmp_path / "told_model.py").write_text(STUB)
    spark.sparkContext.addPyFile(str(tmp_path / "told_model.py"))
    out = str(tmp_path / "out")
    batch.main(["--facts", raw[0], "--dimension", raw[1], "--out", out, "--model", "told_model:make", "--daily", "--contexts", "64", "128"])
    rows = files.read_processed(spark, f"{out}/processed")
    sizes = {r.store: r["count"] for r in rows.groupBy("store").count().collect()}
    assert sizes == {1: 170, 2: 165}
    assert rows.filter("open = 0").count() == 19 and rows.filter("sales is null").count() == 8
    assert rows.filter("(open = 0) <> (closed_run > 0) or (open = 0) <> (days_to_open > 0) or (open = 0 and promo_effect <> 0)").isEmpty()
    found = files.read_forecasts(spark, f"{out}/forecasts")
    value = {r.run: (r.low, r.high, r.n) for r in found.groupBy("run").agg(F.min("median").alias("low"), F.max("median").alias("high"), F.count("*").alias("n")).collect()}
    # Four columns of the table, three of the daily ones and noise: known ahead are the run's own and the daily ones.
    want = {"univariate": 0, "long_horizon": 0, "covariate": 705, "noise": 803, "strong_noise": 703, "shuffle": 704, "missing_future": 704, "time_shift": 704, "trend_break": 704, "feature_drop": 503, "partial_mask": 703, "scaling": 703}
    assert {r: (round(v[0] - 0.5), round(v[1] - 0.5), v[2]) for r, v in value.items() if r != batch.GATED} == {r: (w, w, 180 if r == "long_horizon" else 60) for r, w in want.items()}
    closed = rows.filter("open = 0").count()
    gated = found.filter(F.col("run") == batch.GATED)
    states = spark.read.parquet(f"{out}/mae_open_closed").filter(F.col("run") == batch.GATED).collect()
    assert closed and gated.count() == 60 and gated.filter("median = 0").count() == gated.filter("median < 700").count() > 0 and all(r.mae_closed == 0 and r.mae_open > 0 for r in states)
    assert {r.context_len: r["count"] for r in files.read_forecasts(spark, f"{out}/context_forecasts").groupBy("context_len").count().collect()} == {64: 60, 128: 60}
    assert spark.read.option("header", True).csv(f"{out}/best_context").count() == 2 and spark.read.parquet(f"{out}/context_scores").count() == 4
    # What is there is enough for the other commands.
    import shutil

    for name in ("report", "scores", "figures", "plot_selection"):
        shutil.rmtree(tmp_path / "out" / name)
    batch.main(["evaluate", "--out", out])
    batch.main(["figures", "--out", out])
    assert spark.read.parquet(f"{out}/scores").count() == 26 and spark.read.text(f"{out}/report").first()[0] == report.TITLE
    assert (tmp_path / "out" / "figures" / f"figure=compare_{batch.GATED}").is_dir()


def test_no_series_is_an_error_of_the_job_that_writes(spark, raw, tmp_path):
    with pytest.raises(ValueError, match="no series"):
        batch.run(spark, *raw, str(tmp_path / "out"), shortest=1000)
    for command in (["evaluate"], ["figures"]):
        with pytest.raises(ValueError, match="nothing to read"), pytest.warns(UserWarning, match="missing"):
            batch.main([*command, "--out", str(tmp_path / "none")])


def test_forecasts_of_csv_trees(spark, tmp_path):
    """Names give run and series, folders the context, the order of rows the step; other files are not opened."""
    folder = tmp_path / "tree"
    (folder / "ctx_128").mkdir(parents=True)
    rng = random.Random(7)
    truth = {s: [100 + rng.randrange(50) for _ in range(40)] for s in (0, 12)}
    made = {(r, s): [(y - 10 + k, y + k, y + 12 + k) for y in truth[s]] for s in truth for k, r in enumerate(("univariate", "covariate", "noise"))}
    name = lambda run, s: run + ("_output" if run == "noise" else "") + (f"_store_{s}" if s else "") + ".csv"
    for (run, s), rows in made.items():
        (folder / name(run, s)).write_text("p10,median,p90\n" + "".join(f"{a},{b},{c}\n" for a, b, c in rows))
    for s, ys in truth.items():
        (folder / name("ground_truth", s)).write_text("y_true\n" + "".join(f"{y}\n" for y in ys))
    (folder / "ctx_128" / "univariate_store_12.csv").write_text("p10,median,p90\n1,2,3\n")
    (folder / "other_store_12.csv").write_text("a,b\n1,2\n")
    got = files.read_forecast_files(spark, str(folder), "univariate", "covariate", "noise")
    rows = {(r.run, r.series_id, r.context_len, r.step): (r.p10, r["median"], r.p90) for r in got.collect()}
    assert rows.pop(("univariate", 12, 128, 0)) == (1, 2, 3)
    assert rows == {(run, s, None, i): x for (run, s), part in made.items() for i, x in enumerate(part)}
    assert {f.rsplit("/", 1)[1] for f in files.read_forecast_files(spark, str(folder), "noise").inputFiles()} == {"noise_output.csv", "noise_output_store_12.csv"}
    batch.evaluation(spark, str(tmp_path / "out"), str(folder))
    assert not list(pathlib.Path(shared_folder(spark).removeprefix("file:")).glob("run-*"))
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out/report").collect()]
    assert lines[lines.index("> Noise vs Covariates") + 1] == "MAE: 1.0000" and "> Scaling vs Covariates" not in lines
    loss = lambda y, f, q: max(q * (y - f), (q - 1) * (y - f))
    ys = [(y, *x) for s in truth for y, x in zip(truth[s], made["univariate", s], strict=True)]
    wql = 2 * sum(loss(y, a, 0.1) + loss(y, b, 0.5) + loss(y, c, 0.9) for y, a, b, c in ys) / sum(y for y, *_ in ys) / 3
    assert lines[lines.index("> Univariate vs Ground Truth") + 1] == f"WQL: {wql:.4f}"


def test_settled_tables_of_a_command_are_removed(spark):
    """Also after an error; tables settled outside stay."""
    stays = settled(spark.range(3))
    with pytest.raises(KeyError), removed_after(spark) as folder:
        assert settled(spark.range(5)).count() == 5 and any(pathlib.Path(folder.removeprefix("file:")).iterdir())
        raise KeyError
    assert not pathlib.Path(folder.removeprefix("file:")).exists() and stays.count() == 3
