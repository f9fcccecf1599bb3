"""Whitening of embeddings on the leading eigenvectors of their covariance, found by LOBPCG.

The covariance is never formed: each round multiplies it with a block of at most
three times `block` columns, by one pass over the centred rows. Tasks sum their
part of the product, Spark adds the parts up dimension by dimension, and the
driver holds matrices of dimension x block only. Rayleigh-Ritz on iterate,
residual and previous direction gives the next iterate; the product is made anew
for the whole basis every round, so no rounding error is carried along, and the
residuals that end the search are those of the product itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become floor(SCALE * c) + SHIFT; those beyond LARGEST in size have no such number.
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 52
#: Columns beyond the wanted ones, rounds, and the residual, as a part of the greatest eigenvalue, that must be reached.
GUARD, ROUNDS, CERTIFIED = 8, 300, 1e-9
#: An eigenvalue below this part of the trace counts as 0.
NOTHING = 1e-11


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a vector all of whose entries are finite numbers that fit; the vector as doubles, in column `vector`."""
    doubles = F.col(vector).cast("array<double>")
    bad = F.exists(doubles, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= LARGEST))
    return df.withColumn(vector, doubles).filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad)


def _rows(column, width: int) -> np.ndarray:
    """The vectors of an Arrow list column as whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(-1, width) * SCALE).astype(np.int64) + SHIFT


class Centre:
    """Size and sums of a fit list; subtracts the mean without losing digits to the shift."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums = n, sums
        self.whole = sums // n
        self.part = (sums - self.whole * n) / n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - S)**2, exact; null where it does not fit 64 bits."""
        fits = (np.square(self(x) * float(self.n)).sum(1)) < 9.2e18
        apart = x * np.int64(self.n) - self.sums  # wraps only where the sum does not fit
        return pa.array(np.square(apart).sum(1), pa.int64(), mask=~fits)


def _summed(parts: DataFrame, width: int, columns: int) -> np.ndarray:
    """Adds up rows (dimension, values) of all tasks: a matrix of width x columns."""
    out = np.zeros((width, columns))
    for row in parts.groupBy("dimension").agg(F.array(*[F.sum(F.get("part", F.lit(j))) for j in range(columns)]).alias("part")).collect():  # one row a dimension
        out[row["dimension"]] = row["part"]
    return out


def _by_dimension(make, column_type: str):
    """A task's matrix (or none), as rows (dimension, part)."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(batch.column(0))
                total = part if total is None else total + part
        if total is not None:
            kind = pa.int64() if column_type == "long" else pa.float64()
            flat = pa.array(total.ravel(), kind)
            offsets = pa.array(np.arange(len(total) + 1) * total.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.ListArray.from_arrays(offsets, flat)], names=["dimension", "part"])

    return run


def fit_list(df: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int, Centre | None]:
    """(rows of the most frequent length, the length, their centre); of lengths equally frequent the largest counts."""
    rows = usable(df, vector)
    top = rows.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if top is None:
        return rows, 0, None
    width, n = top["width"], top["count"]
    rows = rows.filter(F.size(vector) == width)
    sums = rows.select(vector).mapInArrow(_by_dimension(lambda c: _rows(c, width).sum(0)[:, None], "long"), "dimension int, part array<long>")
    total = np.zeros(width, np.int64)
    for row in sums.groupBy("dimension").agg(F.sum(F.get("part", F.lit(0))).alias("s")).collect():  # one row a dimension
        total[row["dimension"]] = row["s"]
    return rows, width, Centre(n, total)


def product(rows: DataFrame, width: int, centre: Centre, block: np.ndarray, vector: str = "embedding") -> np.ndarray:
    """The covariance of the rows times `block`: each row is centred before it is multiplied."""

    def make(column):
        x = centre(_rows(column, width))
        return x.T @ (x @ block)

    return _summed(rows.select(vector).mapInArrow(_by_dimension(make, "double"), "dimension int, part array<double>"), width, block.shape[1]) / centre.n


def _basis(*blocks: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span all blocks; each block is freed of those before it, twice, and of what then vanishes."""
    out = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        for _ in range(2):
            block = block - out @ (out.T @ block)
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            block = u[:, s > 1e-8]
        out = np.hstack([out, block])[:, : len(out)]
    return out


def eigenvectors(multiply, width: int, wanted: int, guard: int = GUARD, rounds: int = ROUNDS, certified: float = CERTIFIED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns, residuals) of the positive matrix behind `multiply`.

    Goes on after the residuals are certified until they fall no further, which
    is where rounding sets the limit; raises if they are not certified in time.
    """
    wanted = min(wanted, width)
    many = min(width, wanted + guard)
    x = _basis(np.random.default_rng(0).standard_normal((width, many)))
    before = np.zeros((width, 0))
    q, best, idle = x, np.inf, 0
    for _ in range(rounds):
        vq = multiply(q)
        small = q.T @ vq
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1][:many], y[:, ::-1][:, :many]
        new, vx = q @ y, vq @ y
        residual = vx - new * theta
        size = np.linalg.norm(residual[:, :wanted], axis=0)
        scale = max(theta[0], np.finfo(float).tiny)
        worst = size.max() / scale
        if worst < best:
            kept, idle = (theta[:wanted], new[:, :wanted], size), 0 if worst < best / 2 else idle + 1
            best = worst
        else:
            idle += 1
        if best <= certified and (idle >= 2 or best < 1e-15) or theta[0] <= 0:
            return kept
        before = new - x @ (x.T @ new)
        x = new
        q = _basis(x, residual, before)
    raise RuntimeError(f"residuals of {best:.1e} after {rounds} rounds")


def whiten(df: DataFrame, components: int = 8, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: each vector on the leading eigenvectors, with variance 1 on each.

    Left out are null and empty vectors, those with null, non-finite or too large
    entries, and those that have not the most frequent length. Components are
    numbered from 1 by falling eigenvalue, `components` of them or as many as have
    variance: without any (one vector, equal vectors, an empty table) there are no
    rows. Repeated rows and null keys are rows like others; extra columns are
    ignored. deviation is null where it does not fit 64 bits.
    """
    rows, width, centre = fit_list(df.select(key, vector), vector)
    kind = df.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = df.sparkSession.createDataFrame([], schema)
    if centre is None:
        return empty
    spread = rows.select(vector).mapInArrow(_by_dimension(lambda c: np.square(centre(_rows(c, width))).sum(0)[:, None], "double"), "dimension int, part array<double>")
    trace = float(_summed(spread, width, 1).sum()) / centre.n
    if trace == 0:
        return empty
    values, vectors, _ = eigenvectors(lambda q: product(rows, width, centre, q, vector), width, components)
    there = values > NOTHING * trace
    if not there.any():
        return empty
    values, vectors = values[there], vectors[:, there]
    onto = vectors / np.sqrt(values)
    many, n, explained = len(values), centre.n, values / trace
    mean = rows.select(vector).mapInArrow(_by_dimension(lambda c: (centre(_rows(c, width)) @ onto).sum(0)[:, None], "double"), "dimension int, part array<double>")
    mean = _summed(mean, many, 1)[:, 0] / n

    def second(column):
        w = centre(_rows(column, width)) @ onto - mean
        return w.T @ w

    square = _summed(rows.select(vector).mapInArrow(_by_dimension(second, "double"), "dimension int, part array<double>"), many, many) / n
    error = float(np.abs(square - np.eye(many)).max())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column(1), width)
            at = pa.array(np.repeat(np.arange(len(x)), many))
            white = centre(x) @ onto
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, many + 1), len(x)), pa.int32()), pa.array(np.full(len(at), n), pa.int64()), centre.deviation(x).take(at), pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(key, vector).mapInArrow(run, schema)
