"""Shared lines against SQL over the whole table and plain loops over odd rows."""

import hashlib
import io
from collections import defaultdict
from contextlib import redirect_stdout

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.llm import lines, queries
from tidewater.llm.scratch import written

UPPER = {c: c + 32 for c in range(65, 91)}
LONG = "This licence line is long enough to be looked at, é ß"


def _plain(docs, shortest=40, fewest=5):
    """Rows (doc_id, n_lines, n_dropped, digest) by loops."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = defaultdict(set)
    for i, text in docs:
        for x in (text or "").split("\n"):
            if len(key(x)) >= shortest and i is not None:
                holders[key(x)].add(i)
    out = []
    for i, text in docs:
        own = (text or "").split("\n")
        stay = [x for x in own if len(holders.get(key(x), ())) < fewest or i == max(holders[key(x)])]
        out.append((i, len(own), len(own) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


def test_whole_table_like_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    out = queries.op13_line_dedup(spark, sf_dir)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    got, want = _rows(out), sorted(con.sql(lines.SQL).fetchall(), key=str)
    assert got == want and sum(r[2] for r in got) > 100


def test_odd_rows(spark, docs_of, odd_rows):
    docs = [(i, t, s) for i, t, s in odd_rows]
    docs += [(10 + i, f"own {i}\n  {LONG.upper() if i % 2 else LONG}\t\r\nend\n", "s") for i in range(6)]  # É is no A-Z: two keys of three documents each
    docs += [(30 + i, f"\n{'x' * (39 + i % 2)}\n{LONG}\n{LONG} \n", "s") for i in range(10)]  # 39 and 40 code points, repeated within a text
    docs += [(30, LONG, "s"), (None, LONG, "s"), (None, f"a\n{LONG}", "s"), (None, f"a\n{LONG}", "s"), (60, "é" * 39 + "\n" + "é" * 40, "s")]
    docs += [(61 + i, "é" * 39 + "\n" + "é" * 40, "s") for i in range(5)] + [(70, f"{LONG}\n" * 5000, "s")]
    docs += [(80, "only " + LONG, "s")] * 5  # five rows of one document
    got = _rows(lines.drop_shared(docs_of(docs)))
    assert got == _plain([d[:2] for d in docs]) and sum(r[2] for r in got) > 10


def test_kept_text(spark, docs_of):
    out = lines.drop_shared(docs_of([(i, f"{LONG}\nown {i}", "s") for i in range(5)])).collect()
    assert {(r.doc_id, r.kept) for r in out} == {(i, f"own {i}") for i in range(4)} | {(4, None)}


def test_empty_table(spark, empty):
    out = lines.drop_shared(empty)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"] and out.count() == 0


@pytest.mark.parametrize(("batches", "fan"), [(1, 2), (5, 2), (7, 3)])
def test_runs_add_up(spark, sf_dir, batches, fan):
    keys = written(lines.line_keys(queries.table(spark, sf_dir, "documents")), "lines")
    got = {tuple(r) for r in lines.shared_keys(keys, 2, batches, fan).collect()}
    want = keys.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("d"), F.max("doc_id").alias("largest")).filter("d >= 2")
    assert got == {tuple(r) for r in want.select("h1", "h2", "largest").collect()}


def test_runs_are_disjoint_levelled_and_never_shuffled(spark):
    runs = lines.Runs(spark, 4, fan=2)
    try:
        for k in range(5):
            batch = spark.range(k * 50, k * 50 + 100).selectExpr("id h1", "-id h2", "1L docs", f"{k}L largest")
            name = runs.keep(batch, "batch")
            runs.add(spark.table(name))
        assert [len(x) for x in runs.levels] == [1, 0, 1]  # 5 = 1 + 4
        held = [r.h1 for run in runs.runs() for r in run.collect()]
        assert len(held) == len(set(held)) == 300
        assert runs.totals().agg(F.sum("docs")).first()[0] == 500
        plan = io.StringIO()
        with redirect_stdout(plan):
            spark.table(name).join(runs.runs()[0].select(*lines.HASH).hint("merge"), lines.HASH, "left_anti").explain()
        assert "SortMergeJoin" in plan.getvalue() and "Exchange" not in plan.getvalue()
    finally:
        runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lines_")]
