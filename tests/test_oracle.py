"""Every query with SQL gives the same rows as DuckDB."""

import duckdb
import pytest

from tidewater import queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(r) for r in got.select(columns).collect()), key=key)
    b = sorted(want.select(",".join(f'"{c}"' for c in columns)).fetchall(), key=key)
    assert len(a) == len(b) and a == b


def test_hosted_model(spark, sf_dir):
    rows = queries.QUERIES["g7_hosted_model"](spark, sf_dir).collect()
    assert len(rows) == 750 and all(r.p10 <= r["median"] <= r.p90 for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["series_id", "wql"] and out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
