"""Local days of 23 and 25 hours."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidewater.operators import zoned

ROWS = "key string, ts timestamp_ntz"


@pytest.mark.parametrize("session", ["UTC", "America/New_York"])
def test_days_of_23_and_25_hours(spark, session):
    """All instants of eight days round each change, by Python's clock; the session's zone has no effect."""
    zone, before = ZoneInfo("Europe/Berlin"), spark.conf.get("spark.sql.session.timeZone")
    starts = [dt.datetime(2021, 3, 25), dt.datetime(2021, 10, 28)]
    instants = [s + dt.timedelta(minutes=30 * i) for s in starts for i in range(2 * 24 * 8)]
    try:
        spark.conf.set("spark.sql.session.timeZone", session)
        rows = spark.createDataFrame([("a", t) for t in instants], ROWS)
        got = {r.ts: (r.day, r.hour) for r in zoned.with_local_hour(rows, "Europe/Berlin").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for t in instants:
        day = t.replace(tzinfo=dt.UTC).astimezone(zone).date()
        began = dt.datetime(day.year, day.month, day.day, tzinfo=zone).astimezone(dt.UTC).replace(tzinfo=None)
        assert got[t] == (day, (t - began) // dt.timedelta(hours=1))
    longest = {}
    for day, hour in got.values():
        longest[day] = max(hour, longest.get(day, 0))
    assert longest[dt.date(2021, 3, 28)] == 22 and longest[dt.date(2021, 10, 31)] == 24 and longest[dt.date(2021, 3, 29)] == 23


def test_hours_between_rows_are_gaps(spark):
    """The hour that the clock shows twice is two hours; a series without an instant has no hours; an odd change leaves part of an hour."""
    rows = spark.createDataFrame([("a", dt.datetime(2021, 10, 31, 0)), ("a", dt.datetime(2021, 10, 31, 1, 59)), ("b", dt.datetime(2021, 3, 27, 23)), ("c", None)], ROWS)
    hourly = zoned.with_local_hour(rows, "Europe/Berlin").groupBy("key", "day", "hour").agg(F.count("*").alias("n"))
    got = zoned.local_hours(hourly, "Europe/Berlin", "key").collect()
    a = sorted((r.hour, r.n, r.is_gap) for r in got if r.key == "a")
    assert [x[0] for x in a] == list(range(25)) and [x[0] for x in a if not x[2]] == [2, 3] and all(x[1] == 1 for x in a if not x[2])
    b = [r for r in got if r.key == "b"]
    assert len(b) == 23 and {r.hours for r in b} == {23.0} and [r.hour for r in b if not r.is_gap] == [0] and {r.key for r in got} == {"a", "b"}
    odd = zoned.with_local_hour(spark.createDataFrame([("a", dt.datetime(2021, 4, 3, 14))], ROWS), "Australia/Lord_Howe")
    assert {(r.hours, r["count"]) for r in zoned.local_hours(odd, "Australia/Lord_Howe", "key").groupBy("hours").count().collect()} == {(24.5, 25)}


def test_no_rows(spark):
    empty = zoned.with_local_hour(spark.createDataFrame([], ROWS), "Europe/Berlin")
    assert zoned.local_hours(empty, "Europe/Berlin", "key").count() == 0
