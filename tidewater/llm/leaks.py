"""Benchmark passages in documents, found by spaced seeds.

A seed is a fixed mask over consecutive words; it hashes the words under its
ones and ignores those under its zeros, so a changed word spoils only the seeds
that look at it. Hashes of all benchmark items are joined with those of every
place of every document. On the diagonal of each hit, the longest stretch that is
equal enough must be long enough; no stretch hides another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import filesystem, place, tidied

#: Six words each. However two words of 12, three of 15-18 or four of 20 are changed, one of these shapes finds a place between them.
MASKS = ("1111011", "1010001111", "1111000101", "111010101")
#: For items shorter than a stretch must be: two changed words of 10 or 11, one of 5-9, leave one of these. Shorter ones are looked up as a whole.
SHORT_MASKS, WHOLE_WORDS = ("111", "11011"), 5
#: Benchmark texts of more bytes than this are dealt to blocks, one in memory at a time.
BLOCK_BYTES = 32 << 20
#: Hits looked at together.
HITS = 1 << 20
#: Bytes of documents that a task holds while it goes through the blocks of a large benchmark.
HELD_BYTES = 64 << 20
#: Shortest stretch, in words (or the whole item, if shorter), and its least share of equal words.
LEAST_WORDS, LEAST_EQUAL = 12, 0.8
#: What a changed word costs against +1 for an equal one, so that a stretch of LEAST_EQUAL sums to 0.
CHANGED = round(LEAST_EQUAL / (1 - LEAST_EQUAL))


def _lower(texts):
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return pc.utf8_lower(texts.cast(pa.large_string()))


def _seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash from each word on that has a whole mask after it."""
    size = len(hashes) - len(mask) + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k, on in enumerate(mask):
        if on == "1":
            out += hashes[k : k + size] * W.mix(np.array([k], np.uint64), 23)
    return W.mix(out, len(mask))


def _longest(same: np.ndarray) -> tuple[int, int]:
    """The first longest stretch with at least LEAST_EQUAL equal words, among all there are."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -CHANGED))])
    # For each end the earliest begin whose sum is no larger; the least sums so far never rise.
    begin = np.searchsorted(-np.minimum.accumulate(score), -score, "left")
    end = int((np.arange(len(score)) - begin).argmax())
    return int(begin[end]), end


class Index:
    """Seeds of benchmark items: of long ones by one set of masks, of short ones by another; the shortest are one seed as a whole."""

    def __init__(self, ids: list, texts):
        self.ids, self.items = ids, []
        for _, words in W.chunks(_lower(texts), W.not_alphanumeric()):
            self.items += [words.hash[i:j] for i, j in zip(words.first, words.last, strict=True)]
        long = [len(x) >= LEAST_WORDS for x in self.items]
        short = [WHOLE_WORDS <= len(x) < LEAST_WORDS for x in self.items]
        self.tables = [(m, *self._table(m, some)) for masks, some in ((MASKS, long), (SHORT_MASKS, short)) if any(some) for m in masks]
        #: By length: hash of all words of short items.
        self.short: dict = {}
        for i, item in enumerate(self.items):
            if 0 < len(item) < WHOLE_WORDS:
                self.short.setdefault(len(item), {}).setdefault(int(W.grams(item, len(item))[0][0]), []).append(i)

    def _table(self, mask: str, some: list[bool]):
        found = [_seeds(x if there else x[:0], mask) for x, there in zip(self.items, some, strict=True)]
        key = np.concatenate([*found, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(found)), [len(x) for x in found])
        at = np.concatenate([*(np.arange(len(x)) for x in found), np.zeros(0, int)]).astype(int)
        order = np.argsort(key, kind="stable")
        bits = max(16, int(len(key)).bit_length() + 4)
        near = np.zeros(1 << bits, bool)
        near[(key >> np.uint64(64 - bits)).astype(np.int64)] = True
        key, item, at = key[order], item[order], at[order]
        # Entries that don't follow one of the same seed in their item.
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1)
        return (key, item, at), (key[head], item[head], at[head]), near, np.uint64(64 - bits)

    def _diagonals(self, words: W.Words, row: np.ndarray) -> np.ndarray:
        """Distinct (row, item, place of the item's first word) of all hits, one a line."""
        found = [np.zeros((0, 3), np.int64)]
        for mask, every, heads, near, shift in self.tables:
            seeds = _seeds(words.hash, mask)
            place = np.flatnonzero(near[(seeds >> shift).astype(np.int64)])
            place = place[row[place] == row[place + len(mask) - 1]] if len(place) else place
            # Where a seed follows an equal one, hits go on along diagonals that began before, but for an item's first of equal ones.
            again = (place > 0) & (seeds[place] == seeds[place - 1]) & (row[place] == row[place - 1])
            for some, (key, item, at) in ((place[~again], every), (place[again], heads)):
                low, high = np.searchsorted(key, seeds[some], "left"), np.searchsorted(key, seeds[some], "right")
                some, low, many = some[high > low], low[high > low], (high - low)[high > low]
                ends = np.cumsum(many)
                begin = 0
                while begin < len(some):  # a bounded number of hits at once
                    end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HITS, "right")))
                    n = many[begin:end]
                    which = np.repeat(low[begin:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    where = np.repeat(some[begin:end], n)
                    found.append(np.unique(np.column_stack([row[where], item[which], where - at[which]]), axis=0))
                    begin = end
                    if sum(map(len, found)) > 2 * HITS:
                        found = [np.unique(np.concatenate(found), axis=0)]
        return np.unique(np.concatenate(found), axis=0)

    def hits(self, words: W.Words) -> dict:
        """{row: {item: (start, end, equal)}}, words counted in the row; for each item its longest stretch."""
        row = words.row()
        out: dict = {}
        for r, i, start in self._diagonals(words, row).tolist():
            text, item = words.hash, self.items[i]
            a, b = max(start, int(words.first[r])), min(start + len(item), int(words.last[r]))
            same = text[a:b] == item[a - start : b - start]
            begin, end = _longest(same)
            if end - begin >= min(LEAST_WORDS, len(item)):
                equal = int(same[begin:end].sum())
                self._add(out, r, i, a + begin - int(words.first[r]), a + end - int(words.first[r]), equal)
        sizes = sorted(self.short)
        for size, (grams, whole) in zip(sizes, words.grams(*sizes), strict=True):
            keys = self.short[size]
            known = np.fromiter(keys, np.uint64, len(keys))
            for p in np.flatnonzero(whole & np.isin(grams, known)):
                for i in keys[int(grams[p])]:
                    begin = int(p - words.first[row[p]])
                    self._add(out, int(row[p]), i, begin, begin + size, size)
        return out

    def _add(self, out: dict, r: int, i: int, begin: int, end: int, equal: int) -> None:
        best = out.setdefault(r, {}).get(self.ids[i])
        if best is None or (end - begin, -begin) > (best[1] - best[0], -best[0]):
            out[r][self.ids[i]] = (begin, end, equal)


def _blocks(benchmark: DataFrame):
    """What loads the index, block by block, on an executor. A small benchmark is sent whole; a large one is read from the shared folder."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if total <= BLOCK_BYTES:
        table = items.toArrow()
        sent = spark.sparkContext.broadcast((table.column(0).to_pylist(), table.column(1).combine_chunks()))
        made: list = []

        def whole():
            if not made:
                made.append(Index(*sent.value))
            yield made[0]

        return whole
    path = place(spark, "benchmark")
    items.repartition(int(total // BLOCK_BYTES) + 1, "item_id").write.parquet(path)

    def each():
        import pyarrow.parquet as pq
        from pyarrow import fs as arrow_fs

        store, inner = filesystem(path)
        for f in sorted(x.path for x in store.get_file_info(arrow_fs.FileSelector(inner)) if x.path.endswith(".parquet")):
            table = pq.read_table(f, filesystem=store)
            if table.num_rows:
                yield Index(table.column("item_id").to_pylist(), table.column("text").combine_chunks())

    return each


def _held(batches, at: int):
    """Lists of batches whose texts, column `at`, come to HELD_BYTES or the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(at).nbytes
        if size >= HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _with_hits(batches, at: int, blocks):
    """(batch, hits by row) of every batch; an index is made once for all batches held."""
    for held in _held(batches, at):
        found: list[dict] = [{} for _ in held]
        for index in blocks():
            for batch, out in zip(held, found, strict=True):
                for low, words in W.chunks(_lower(batch.column(at)), W.not_alphanumeric()):
                    for r, items in index.hits(words).items():
                        have = out.setdefault(low + r, {})
                        for i, x in items.items():
                            if i not in have or x[1] - x[0] > have[i][1] - have[i][0]:
                                have[i] = x
        yield from zip(held, found, strict=True)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids (ascending) and spans (item_id, first and last word, equal words).

    Words are runs of letters, digits and characters beyond ASCII, in lower case.
    Null and empty texts have no hits; items without id or text are no items; an
    empty benchmark finds nothing. Repeated rows are judged one by one. Extra
    columns are ignored.
    """
    blocks = _blocks(benchmark)
    spans = pa.list_(pa.struct([("item_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("equal", pa.int32())]))

    def run(batches):
        for batch, hits in _with_hits(batches, 1, blocks):
            per = [sorted(hits.get(i, {}).items()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([bool(x) for x in per]), pa.array([[i for i, _ in x] for x in per], pa.list_(pa.int64())), pa.array([[{"item_id": i, "first": a, "last": b - 1, "equal": e} for i, (a, b, e) in x] for x in per], spans)],
                names=["doc_id", "contaminated", "item_ids", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, contaminated boolean, item_ids array<long>, spans array<struct<item_id:long,first:int,last:int,equal:int>>")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark passage.

    Null and empty texts hold none and stay, as do all rows for an empty benchmark;
    repeated rows stay or go together; an empty table gives no rows. Columns of docs
    may have any other names.
    """
    blocks = _blocks(benchmark)
    at = docs.columns.index("text")

    def run(batches):
        for batch, hits in _with_hits(batches, at, blocks):
            keep = np.ones(batch.num_rows, bool)
            keep[list(hits)] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidied(run), docs.schema)
