"""Whitening against an eigenvalue solver over the whole table, and on hand-made vectors."""

import math

import numpy as np
import pytest

from tidewater.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, "c", "n") for i, v in rows], SCHEMA)


def _plain(vectors):
    """(whole numbers, eigenvalues falling, eigenvectors) by numpy."""
    x = np.floor(np.asarray(vectors, np.float32).astype(float) * 1024).astype(np.int64) + 100000
    c = x - x.sum(0) / len(x)
    values, v = np.linalg.eigh(c.T @ c / len(x))
    return x, c, values[::-1], v[:, ::-1]


def _agrees(rows, vectors, ids, components):
    x, c, values, v = _plain(vectors)
    want = c @ v[:, :components] / np.sqrt(values[:components])
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * components
    white = np.array([[got[i, k + 1].whitened for k in range(components)] for i in ids])
    white *= np.sign((white * want).sum(0))
    assert np.allclose(white, want, rtol=0, atol=1e-9)
    deviation = [sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(0), strict=True)) for row in x]
    assert [got[i, 1].deviation for i in ids] == deviation
    for k in range(components):
        assert math.isclose(got[ids[0], k + 1].explained, values[k] / values.sum(), rel_tol=1e-9)
    assert {r.n for r in rows} == {len(x)} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whole_table(spark, sf_dir):
    table = queries.table(spark, sf_dir, "embeddings").collect()
    _agrees(queries.op11_whitening(spark, sf_dir).collect(), [r.embedding for r in table], [r.vec_id for r in table], 8)


def test_rows_that_are_left_out(spark):
    good = [(i, [float(x) for x in np.random.default_rng(i).normal(size=5)]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [math.nan] * 5), (104, [math.inf, 1.0, 1.0, 1.0, 1.0]), (105, [1.0, 2.0]), (106, [3e38] * 5)]
    rows = whitening.whiten(_table(spark, good + bad)).collect()
    _agrees(rows, [v for _, v in good], [i for i, _ in good], 5)


def test_ties_repeats_and_null_keys(spark):
    # Two directions of equal variance: any basis of their plane will do.
    rows = [(i, v) for i, v in enumerate([[1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, -1.0, 0.0]])]
    out = whitening.whiten(_table(spark, rows + rows[:0])).collect()
    assert {r.component for r in out} == {1, 2} and out[0].identity_error < 1e-9
    assert all(math.isclose(sum(r.whitened**2 for r in out if r.vec_id == i), 2.0, rel_tol=1e-9) for i in range(4))
    again = whitening.whiten(_table(spark, [(None, v) for _, v in rows] + rows[:1])).collect()
    assert len(again) == 10 and sum(r.vec_id is None for r in again) == 8


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    out = whitening.whiten(_table(spark, rows))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_deviation_beyond_64_bits_is_null(spark):
    rows = whitening.whiten(_table(spark, [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 0.5])])).collect()
    assert {r.deviation for r in rows if r.vec_id in (1, 2)} == {None} and {r.deviation for r in rows if r.vec_id == 3} != {None}


def test_search_for_eigenvectors():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    values = np.concatenate([[9.0, 9.0, 8.999, 5.0], np.linspace(4.9, 0.1, 196)])
    matrix, calls = (q * values) @ q.T, []

    def multiply(block):
        calls.append(block.shape[1])
        return matrix @ block

    found, vectors, residual = whitening.eigenvectors(multiply, 200, 4)
    assert np.allclose(found, values[:4], rtol=1e-12) and residual.max() < 1e-9 * 9
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert max(calls) <= 3 * (4 + whitening.GUARD)  # blocks only, never the matrix
    with pytest.raises(RuntimeError, match="residuals"):
        whitening.eigenvectors(multiply, 200, 4, rounds=2)


def test_product_is_centred(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 6)).round(2).tolist()
    rows, width, centre = whitening.fit_list(_table(spark, list(enumerate(vectors))))
    _, c, _, _ = _plain(vectors)
    block = rng.normal(size=(6, 3))
    assert np.allclose(whitening.product(rows, width, centre, block), c.T @ (c @ block) / 300, rtol=1e-12)
