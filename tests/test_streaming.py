"""Streams give the rows of the batch, also after a restart and with late or repeated rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators.sessions import sessions
from tidewater.sources import series
from tidewater.streaming.filled import filled_batch, filled_stream
from tidewater.streaming.hourly import hourly
from tidewater.streaming.matched import matched, write_once

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(df, name, folder, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").start()
    query.processAllAvailable()
    query.stop()


def test_stream_gives_the_batch_hours(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").limit(3000)
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    _start(hourly(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")), "hours", tmp_path)
    got = {(r.series, r.ts): (r.target, r.amount) for r in spark.table("hours").collect()}
    batch = {(r.series, r.ts): (r.target, r.amount) for r in hourly(events).collect()}
    assert got and all(batch[k] == v for k, v in got.items())
    assert max(t for _, t in got) < max(t for _, t in batch)


def test_batch_hours_are_the_series(spark, sf_dir):
    a = {(r.series, r.ts.replace(tzinfo=None)): r.target for r in hourly(spark.read.parquet(f"{sf_dir}/events.parquet")).collect()}
    b = {(r.series, r.ts.replace(tzinfo=None)): r.target for r in series.events_hourly(spark, sf_dir).collect()}
    assert a == b


def test_sessions_by_hand(spark):
    t = lambda m, s=0: dt.datetime(2024, 1, 1, 0, m, s)
    rows = [(1, t(0), 1.0), (1, t(10), 2.5), (1, t(20, 1), 1.0), (2, t(5), None), (None, t(1), 1.0), (3, None, 1.0), (1, t(10), 4.0)]
    out = sessions(spark.createDataFrame(rows, "user_id long, ts timestamp, value double"), gap="10 minutes").collect()
    assert sorted((r.user_id, r.start, r.last, r.events, r.amount) for r in out) == [(1, t(0), t(10), 3, 7.5), (1, t(20, 1), t(20, 1), 1, 1.0), (2, t(5), t(5), 1, None)]


def test_session_stream_is_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").limit(2500).select("user_id", "ts", "value").cache()
    parts = events.randomSplit([1.0, 1.0, 1.0], 7)  # each file has rows of all times, so two thirds come late
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    _start(sessions(stream, gap="2 hours", late="40 days"), "sessions_none", tmp_path)
    assert spark.table("sessions_none").count() == 0  # nothing is over before its watermark
    end = spark.createDataFrame([(0, dt.datetime(2025, 1, 1), 0.0)], events.schema)
    end.coalesce(1).write.parquet(f"{tmp_path}/in/9")
    _start(sessions(stream, gap="2 hours", late="40 days"), "sessions", tmp_path)
    got = sorted(map(tuple, spark.table("sessions").collect()))
    assert got == sorted(map(tuple, sessions(events, gap="2 hours").collect())) and len(got) > 500


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def test_filled_stream_restarts_and_is_the_batch(spark, tmp_path, rocks):
    rng = random.Random(5)
    begin = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("abc"), begin + dt.timedelta(hours=h), None if rng.random() < 0.3 else float(h)) for h in range(240) for _ in range(2)]
    rows += [(None, begin, 1.0), ("a", None, 1.0)]
    schema = "series string, ts timestamp, value double"
    table = spark.createDataFrame(rows, schema)
    days = [[r for r in rows if r[1] is not None and (r[1] - begin).days == d] for d in range(10)]
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = filled_stream(stream, "12 hours")
    for d, own in enumerate(days):
        rng.shuffle(own)
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{d}")
        if d in (4, 9):  # stopped after five days, then begun again from its checkpoint
            query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
            query.processAllAvailable()
            query.stop()
    got = {(r.series, r.ts): (r.value, r.forecast) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.series, r.ts): (r.value, r.forecast) for r in filled_batch(table).collect()}
    assert len(got) > 0.9 * len(want) and all(want[k] == v for k, v in got.items())
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got)
    assert {k for k in want if k[1] <= begin + dt.timedelta(hours=226)} <= set(got)
    assert any(v[1] is not None for v in got.values())


def test_forecasts_meet_truth_as_it_comes(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    forecasts = spark.createDataFrame([(s, day(i), day(i + k), 1.0, 2.0, 3.0) for s in (1, 2) for i in range(0, 20, 5) for k in range(1, 8)] + [(1, day(0), day(200), 1.0, 2.0, 3.0), (None, day(0), day(1), 1.0, 2.0, 3.0)], "series_id long, issued timestamp, ts timestamp, p10 double, median double, p90 double")
    truths = spark.createDataFrame([(s, day(d), float(d)) for s in (1, 2) for d in range(25)] + [(1, day(200), 0.0), (1, None, 1.0)], "series_id long, ts timestamp, y_true double")
    forecasts.coalesce(1).write.parquet(f"{tmp_path}/f")
    truths.filter("ts < '2024-01-12'").coalesce(1).write.parquet(f"{tmp_path}/t/0")
    of = lambda df, path: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    joined = matched(of(forecasts, f"{tmp_path}/f"), of(truths, f"{tmp_path}/t/*"))
    seen = []
    sink = write_once(f"{tmp_path}/out")

    def write(batch, number):
        seen.append((number, batch.count()))
        sink(batch, number)
        sink(batch, number)  # as after a failure between the write and the commit

    for late in (None, "ts >= '2024-01-12'"):
        if late:
            truths.filter(late).coalesce(1).write.parquet(f"{tmp_path}/t/1")
        query = joined.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        query.stop()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").drop("batch").collect()))
    want = matched(forecasts, truths)
    assert got == sorted(map(tuple, want.collect())) and len(got) == 56
    assert want.filter(F.col("y_true") != F.datediff("ts", F.lit("2024-01-01"))).count() == 0
    assert sum(n for _, n in seen) == len(got) and sum(n > 0 for _, n in seen) >= 2
