"""One long series against the keyed operators, and joins along time against loops."""

import datetime as dt
import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tidewater.functions.ranges import bounds, range_of
from tidewater.operators import perturb, relational, single, timed
from tidewater.sources import series


def _plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def _same(a, b, columns):
    x, y = (sorted(map(str, df.select(*columns).collect())) for df in (a, b))
    assert len(x) == len(y) and x == y


@pytest.fixture(scope="module")
def train(spark, sf_dir):
    return series.train(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def placed(train):
    return single.place(train, ["dt", "store"], 7)


@pytest.fixture(scope="module")
def constant(train):
    """The same rows under a constant key, in one task."""
    return series.indexed(train.withColumn("one", F.lit(1)).withColumn("both", F.struct("dt", "store")), "one", "both")


def test_single_series_is_in_many_tasks(placed):
    assert len(placed.sizes) == 7 and max(n for _, n in placed.sizes) < 0.4 * placed.length
    for df in (placed.indexed(), single.filled(placed, ["sales"], True), single.time_shift(placed), single.shuffled(placed), *single.split(placed)):
        assert "SinglePartition" not in _plan(df)


@pytest.mark.parametrize("backward", [False, True])
def test_single_fill_is_the_constant_key_fill(train, placed, constant, backward):
    names = ["sales", "open", "school_holiday", "state_holiday"]
    want = relational._filled(constant, "one", "idx", names, backward)
    _same(single.filled(placed, names, backward), want, [*train.columns, "idx"])
    fill = relational.fill_both if backward else relational.forward_fill
    _same(fill(train, None, ("dt", "store"), names), want, [*train.columns, "idx"])


def test_single_split_shift_and_perturbations(train, placed, constant):
    columns = [*train.columns, "idx"]
    for a, b in zip(relational.split(train, 45, None, ("dt", "store")), relational.split(constant, 45, "one"), strict=True):
        _same(a, b, columns)
    _same(single.time_shift(placed, "promo", 7), perturb.time_shift(constant, "promo", 7, "one"), columns)
    for change in (perturb.missing_future, perturb.trend_break):
        _same(change(placed.sized(), key="none"), change(constant, key="one"), columns)
    out = single.shuffled(placed).select("idx", "promo").collect()
    assert sorted(r.idx for r in out) == list(range(placed.length))
    before = [r.promo for r in sorted(placed.indexed().select("idx", "promo").collect())]
    after = [r.promo for r in sorted(out)]
    assert sorted(after) == sorted(before) and after != before


def test_single_edges(spark):
    rows = spark.createDataFrame([(i, None, i if i % 100 == 50 else None) for i in range(1000)], "i long, a string, b long")
    out = {r.i: r for r in single.filled(single.place(rows, "i", 16), ["a", "b"], True).collect()}
    assert all(out[i].a is None and out[i].idx == i for i in range(1000))
    assert [out[i].b for i in (0, 49, 50, 149, 150, 999)] == [50, 50, 50, 50, 150, 950]
    empty = single.place(rows.limit(0), "i")
    assert single.filled(empty, ["b"]).count() == 0 and empty.length == 0
    with pytest.raises(ValueError, match="too small"):
        single.split(single.place(rows.limit(30), "i"))


def test_ranges(spark):
    df = spark.range(10000).select((F.col("id") * F.col("id")).alias("x"))
    ends = bounds(df, 700)
    assert len(ends) == 14
    got = {r.r: r["count"] for r in df.select(range_of(F.col("x"), ends).alias("r")).groupBy("r").count().collect()}
    assert sorted(got) == list(range(15)) and max(got.values()) < 1100
    for ends in ([], [5], [1, 2, 3, 9], list(range(0, 37, 3))):
        out = spark.range(-2, 40).select("id", range_of(F.col("id"), ends).alias("r")).collect()
        assert all(r.r == sum(e < r.id for e in ends) for r in out)


def _events(seed: int, n: int, hot: float):
    rng = random.Random(seed)
    begin = dt.datetime(2024, 1, 1)
    return [(None if rng.random() < 0.03 else "hot" if rng.random() < hot else f"k{rng.randrange(5)}", None if rng.random() < 0.03 else begin + dt.timedelta(seconds=rng.randrange(4000)), i) for i in range(n)]


@pytest.mark.parametrize(("range_rows", "tolerance"), [(10**6, None), (40, None), (25, 30)])
def test_asof_join_like_loops(spark, range_rows, tolerance):
    a, b = _events(1, 400, 0.5), _events(2, 150, 0.3)
    left, right = (spark.createDataFrame(x, f"k string, ts timestamp_ntz, {n} int") for x, n in ((a, "i"), (b, "j")))
    joined = timed.asof_join(left, right, "ts", ["k"], tolerance, range_rows=range_rows)
    got = {r.i: (r.matched_ts, r.matched_j) for r in joined.collect()}
    for k, ts, i in a:
        own = [(x[1], x[2]) for x in b if k is not None and ts is not None and x[0] == k and x[1] is not None and x[1] <= ts]
        best = max(own, default=(None, None))
        if best[0] is not None and tolerance is not None and (ts - best[0]).total_seconds() > tolerance:
            best = (None, None)
        assert got[i] == best
    assert len(got) == len(a) and joined.columns == ["k", "ts", "i", "matched_ts", "matched_j"]


def test_asof_join_splits_a_hot_key(spark):
    left = spark.range(20000).selectExpr("1 as k", "id as at")
    right = spark.range(0, 20000, 10).selectExpr("1 as k", "id as at", "id * 2 as v")
    out = timed.asof_join(left, right, "at", ["k"], range_rows=2000)
    assert out.filter("matched_v <> 2 * (at - at % 10)").count() == 0 and out.count() == 20000
    ends = bounds(left.select("at"), 2000)
    sizes = [r["count"] for r in left.groupBy(range_of(F.col("at"), ends)).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 3000
    assert "SinglePartition" not in _plan(out) and "NestedLoop" not in _plan(out)


def test_asof_join_without_key_or_rows(spark):
    left = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (1, 5, 9)], "day date, i int")
    right = spark.createDataFrame([(dt.date(2024, 1, 4), "a"), (dt.date(2024, 1, 4), "b")], "day date, v string")
    got = {r.i: r.matched_v for r in timed.asof_join(left, right, "day", tolerance=2, range_rows=1).collect()}
    assert got == {1: None, 5: "b", 9: None}
    assert [r.matched_v for r in timed.asof_join(left, right.limit(0), "day").collect()] == [None] * 3
    assert timed.asof_join(left.limit(0), right, "day").count() == 0
    with pytest.raises(TypeError):
        timed.asof_join(right, right, "v")


def _intervals(seed: int, n: int):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        low = rng.randrange(-5000, 5000)
        length = rng.choice([0, 0, 1, 7, 8, 63, 64, 500, 9000, -1])
        out.append((rng.choice(["a", "b", None]) if rng.random() < 0.5 else "hot", None if rng.random() < 0.02 else low, low + length, i))
    return out


def test_overlap_join_like_loops(spark):
    a, b = _intervals(3, 250), _intervals(4, 250)
    left, right = (spark.createDataFrame(x, "k string, lo long, hi long, i int") for x in (a, b))
    joined = timed.overlap_join(left, right, ("lo", "hi"), ("lo", "hi"), ["k"])
    got = [(r.i, r.matched_i) for r in joined.collect()]
    ok = lambda x: x[0] is not None and x[1] is not None and x[1] <= x[2]
    want = [(x[3], y[3]) for x in a for y in b if ok(x) and ok(y) and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]]
    assert sorted(got) == sorted(want) and len(want) > 1000
    assert "NestedLoop" not in _plan(joined) and "Cartesian" not in _plan(joined)


def test_range_join_of_days(spark):
    days = spark.createDataFrame([(dt.date(2023, 12, 30) + dt.timedelta(days=i), i) for i in range(60)], "day date, i int")
    spans = spark.createDataFrame([(dt.date(2023, 12, 31), dt.date(2024, 1, 2), "x"), (dt.date(2020, 1, 1), dt.date(2030, 1, 1), "y"), (dt.date(2024, 1, 2), dt.date(2024, 1, 1), "z")], "a date, b date, v string")
    got = sorted((r.i, r.matched_v) for r in timed.range_join(days, spans, "day", ("a", "b")).collect())
    assert got == sorted([(i, "x") for i in (1, 2, 3)] + [(i, "y") for i in range(60)])
    assert timed.range_join(days, spans.limit(0), "day", ("a", "b")).count() == 0


def test_long_intervals_do_not_spread(spark):
    """An interval of any length takes two rows at most for each level that occurs."""
    rows = timed._dealt(spark.createDataFrame([(0, 0), (5, 10**12), (-(10**15), 10**15)], "lo long, hi long"), "lo", "hi", [], "_a")
    assert timed._binned(rows, "_a", timed._levels(rows, "_a")).count() <= 2 * 3 * 3
