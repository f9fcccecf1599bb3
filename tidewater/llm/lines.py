"""Removal of lines that many documents share, by levelled sorted runs of line hashes.

A run is a table of keys (128-bit hashes of normalised lines), each with the
number of documents and the largest doc_id it came with, bucketed by hash and
sorted within buckets. Every key is in one run at most: a new batch is
merge-anti-joined with each run, what is left becomes a run of its own, and the
rest, keys that an earlier batch had, goes to the repeats. When a level has
`fan` runs, they are compacted into one run of the level above. As all runs and
batches have the same buckets, none of these joins shuffles anything. What a key
counts in all is its run's row and its repeats.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import packed, unpacked
from .scratch import place, tidied, written

WHITE = b" \t\n\x0b\x0c\r"
#: Rows of a bucket, and Spark's own limit on buckets.
BUCKET_ROWS, MOST_BUCKETS = 1 << 22, 100_000
#: Batches that a table is dealt into, and runs of a level that are compacted into one.
BATCHES, FAN = 6, 3
HASH = ["h1", "h2"]


def key_of(line: bytes, shortest: int) -> bytes | None:
    """The hash of a line without white space at its ends, A-Z lower-cased; None if that has fewer than `shortest` code points."""
    line = line.strip(WHITE)
    if len(line) < shortest:
        return None
    if not line.isascii() and len(line.decode("utf-8", "replace")) < shortest:
        return None
    return hashlib.blake2b(line.lower(), digest_size=16).digest()


def _keys(shortest: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            row, found = [], []
            for i, text in enumerate(texts):
                if text.is_valid:
                    own = {k for k in (key_of(x, shortest) for x in text.as_py().split(b"\n")) if k}
                    row += [i] * len(own)
                    found += own
            if found:
                h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(at), batch.column(1).take(at)], names=["h1", "h2", "doc_id", "text_key"])

    return run


def line_keys(docs: DataFrame, shortest: int = 40) -> DataFrame:
    """(h1, h2, doc_id, text_key): the distinct keys of each row's lines."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(tidied(_keys(shortest)), "h1 long, h2 long, doc_id long, text_key long")


@dataclass
class Runs:
    """Levelled runs in the shared folder, as tables of the session's catalog; `close` takes them out again."""

    spark: SparkSession
    buckets: int
    fan: int = FAN
    levels: list[list[str]] = field(default_factory=list)
    repeats: list[DataFrame] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def keep(self, df: DataFrame, kind: str, *parts: str) -> str:
        """df as a bucketed, sorted table; its name."""
        name = f"lines_{kind}_{uuid.uuid4().hex}"
        writer = df.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", place(self.spark, name))
        (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
        self.names.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, docs, largest) with each key once, bucketed as the runs are."""
        fresh = batch
        for run in self.runs():
            fresh = fresh.join(run.select(*HASH).hint("merge"), HASH, "left_anti")
        run = self.keep(fresh, "run")
        if any(self.levels):
            self.repeats.append(written(batch.join(self.spark.table(run).select(*HASH).hint("merge"), HASH, "left_anti"), "repeats"))
        self._place(run, 0)

    def _place(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            small, self.levels[level] = self.levels[level], []
            self._place(self.keep(reduce(DataFrame.unionByName, map(self.spark.table, small)), "run"), level + 1)

    def totals(self) -> DataFrame:
        """(h1, h2, docs, largest) of every key: its run's row and its repeats."""
        if not self.repeats:
            return reduce(DataFrame.unionByName, self.runs())
        sums = reduce(DataFrame.unionByName, self.repeats).groupBy(*HASH).agg(F.sum("docs").alias("more"), F.max("largest").alias("later"))
        again = self.spark.table(self.keep(sums, "sums"))
        own = reduce(DataFrame.unionByName, [run.join(again.hint("merge"), HASH, "left") for run in self.runs()])  # bucket by bucket
        return own.select(*HASH, (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("largest", "later").alias("largest"))

    def close(self) -> None:
        """Takes the tables out of the catalog; their files stay where results still read them."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names.clear()


def shared_keys(keys: DataFrame, fewest: int, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """(h1, h2, largest) of the keys that at least `fewest` documents have. keys: a written table of line_keys."""
    spark = keys.sparkSession
    buckets = max(1, min(MOST_BUCKETS, keys.count() // BUCKET_ROWS + spark.sparkContext.defaultParallelism))
    runs = Runs(spark, buckets, fan)
    try:
        # A row without doc_id is no document that counts. Rows of one doc_id are one document, and in one batch.
        counted = keys.filter("doc_id is not null").withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
        dealt = runs.keep(counted.groupBy("batch", *HASH).agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("largest")), "dealt", "batch")
        for k in range(batches):
            runs.add(spark.table(dealt).filter(F.col("batch") == k).drop("batch"))
        return written(runs.totals().filter(F.col("docs") >= fewest).select(*HASH, "largest"), "shared-lines")
    finally:
        runs.close()


def _apply(shortest: int):
    def run(batches):
        for batch in batches:
            out: dict = {k: [] for k in ("doc_id", "n_lines", "n_dropped", "kept_sha256", "kept")}
            for doc_id, text, gone in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)), batch.column(2), strict=True):
                text = text or b""
                total, dropped = text.count(b"\n") + 1, 0
                if gone.is_valid:
                    h = [np.asarray(gone.values.field(i)).astype("<i8") for i in (0, 1)]
                    cut = {x.tobytes() for x in np.stack(h, 1)}
                    stay = [x for x in text.split(b"\n") if key_of(x, shortest) not in cut]
                    text, dropped = b"\n".join(stay), total - len(stay)
                for k, v in zip(out, (doc_id, total, dropped, hashlib.sha256(text).hexdigest(), text if dropped else None), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["n_lines"], pa.int64()), pa.array(out["n_dropped"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary()).cast(pa.string())], names=list(out))

    return run


def drop_shared(docs: DataFrame, shortest: int = 40, fewest: int = 5, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and kept (null where nothing was dropped) of every row.

    A line's key is the line without bytes 0x20 and 0x09-0x0D at its ends, A-Z
    lower-cased. A key of `shortest` code points or more that `fewest` documents
    or more have keeps its lines in the largest doc_id only, there all of them. A
    null or empty text is one empty line. Rows that repeat a doc_id are one
    document, each row with its own lines; rows without doc_id count for no key
    and lose what others lose. Extra columns are ignored.
    """
    keys = written(line_keys(docs, shortest), "lines")
    shared = shared_keys(keys, fewest, batches, fan)
    gone = keys.join(shared, HASH).filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("largest"))).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(*HASH)).alias("gone"))
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "text_key": "gone_key"})
    rows = packed(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), "doc_id", "text_key")
    joined = rows.join(gone, rows.doc_id.eqNullSafe(gone.gone_id) & (rows.text_key == gone.gone_key), "left")
    return joined.select("doc_id", "packed", "gone").mapInArrow(tidied(_apply(shortest)), "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string")


#: The digests of drop_shared over the table documents, for DuckDB.
SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM placed),
shared AS (SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, i, line, shared.key IS NOT NULL AND (doc_id IS NULL OR doc_id <> largest) AS gone FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
