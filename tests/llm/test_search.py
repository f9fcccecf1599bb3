"""Ranked search against SQL over whole tables and plain loops over odd rows."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tidewater.llm import queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def _plain(docs, items, top=20):
    """Rows (item_id, rank, doc_id, score) by loops over all pairs; None ranks last among equal scores."""
    terms = lambda t: Counter(TERM.findall((t or "").translate(UPPER)))
    own = [(i, terms(t)) for i, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, c), size in zip(own, sizes, strict=True):
            m = 100 - 25 + (25 * size * n_docs) // max(total, 1)
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in terms(text).items() if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        scores.sort()
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(scores[:top])]
    return out


def _rows(df):
    key = lambda r: (str(r[0]), r[1])
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_whole_tables_like_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    out = queries.op12_ranked_search(spark, sf_dir)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert _rows(out) == sorted(con.sql(search.SQL).fetchall(), key=lambda r: (str(r[0]), r[1]))


def test_odd_rows_and_ties(spark, docs_of, odd_rows):
    docs = [(i, t, s) for i, t, s in odd_rows] + [(20 + i, "Alpha beta, the ALPHA-42 " + "pad " * (i % 3), "s") for i in range(60)] + [(None, "alpha beta the alpha 42 ", "s"), (3, "one two", "s"), (90, "İstanbul Éa éa ſ", "s"), (91, "a_b ab a'b", "s")]
    items = [(1, "alpha the the 42 ONE"), (2, None), (3, ""), (4, "nothing_here zz"), (5, "éa Éa İstanbul istanbul a b"), (5, "w x"), (None, "beta"), (7, "alpha " * 500)]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score int")
    got = sorted(map(str, _rows(search.search(docs_of(docs), table))))
    want = sorted(map(str, _plain([d[:2] for d in docs], items)))
    assert got == want and len(got) > 60


def test_blocks_of_items_change_nothing(spark, sf_dir):
    docs, items = (queries.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    assert _rows(search.search(docs, items, 5, 4000)) == _rows(search.search(docs, items, 5))


def test_small_runs_of_matches(monkeypatch):
    """A task that sorts few matches at once keeps the same documents."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(300)]
    items = ["a b c", "d d e", "h"]
    block = search.Block(items)

    def rows():
        matched = pa.Table.from_batches(search._matched(block.terms)(iter([pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], names=["doc_id", "text"])])))
        weight = np.full(len(block), 700)
        batches = matched.select(["rank_id", "n", "terms", "counts"]).to_batches(max_chunksize=37)
        return sorted(map(str, pa.Table.from_batches(search._best(block, weight, 300, 1500, 7)(iter(batches))).to_pylist()))

    whole = rows()
    monkeypatch.setattr(search, "MATCHES", 5)
    assert rows() == whole and len(whole) == 21


def test_empty_tables(spark, empty, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert search.search(odd, none).count() == 0 and search.search(empty, one).count() == 0
    assert search.search(empty, one).columns == ["item_id", "rank", "doc_id", "score"]


@given(st.lists(st.tuples(st.integers(0, 5000), st.integers(0, 299), st.integers(0, 2**40)), max_size=300))
def test_accumulation(rows):
    item, doc, impact = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    want = Counter()
    for i, d, v in rows:
        want[i, d] += v
    got = list(zip(*(x.tolist() for x in search.accumulated(item, doc, impact, 300)), strict=True))
    assert got == sorted((i, d, v) for (i, d), v in want.items())


@given(st.lists(st.integers(0, 2**62), max_size=200))
def test_radix_order_is_stable(values):
    key = np.array(values, np.int64)
    assert search.radix_order(key).tolist() == np.argsort(key, kind="stable").tolist()
