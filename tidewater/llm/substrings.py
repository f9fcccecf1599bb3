"""Removal of passages that an earlier document has too.

A window is `size` consecutive words. Every window is filed under the smallest
hash among its `gram`-word pieces, so equal windows share that piece: the number
of documents with the piece is never below that of documents with the window.
Pass 1 counts pieces in count-min sketches, one a task, merged by cell range.
Pass 2 lists, for pieces estimated to be in two documents or more, the run of
windows filed under them, and groups those exactly. The merged sketch is folded
to the least size at which few cells are taken, so what is broadcast follows the
data up to a fixed bound; a fuller sketch lets more windows through to the exact
grouping and loses none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .packing import packed, unpacked
from .scratch import tidied, written

#: 3 rows of 2**29 cells, one bit each after merging, folded to 2**23 cells at least: 3 to 192 MB.
ROWS, CELL_BITS, SLICE_BITS = 3, 29, 23
#: Rows are folded while no more than one cell in this many is taken.
SPARE = 16
#: 36 bits of a hash and 28 bits of a place decide which piece of a window is smallest.
PLACE = np.uint64((1 << 28) - 1)


def _filed(words: W.Words, size: int, gram: int):
    """Runs of windows filed under one piece: first window, how many, the piece's hash; window hashes."""
    (pieces, _), (windows, whole) = words.grams(gram, size)
    at = np.arange(len(pieces), dtype=np.uint64)
    least = W.sliding_min((pieces & ~PLACE) | at, size - gram + 1)[: len(windows)]
    valid = np.flatnonzero(whole)
    place = (least[valid] & PLACE).astype(np.int64)
    row = words.row()[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (np.diff(place) != 0) | (np.diff(row) != 0) | (np.diff(valid) != 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(valid)))
    return valid[head], count, pieces[place[head]], row[head], windows


def _cells(piece: np.ndarray, row: int) -> np.ndarray:
    return W.mix(piece, 11 + row) >> np.uint64(64 - CELL_BITS)


def _partial_sketch(size: int, gram: int):
    breaks = W.white_space()
    schema = pa.schema([("row", pa.int32()), ("slice", pa.int32()), ("cells", pa.binary())])

    def run(batches):
        seen: list[np.ndarray] = []

        def flush():
            piece = np.concatenate(seen)
            seen.clear()
            for row in range(ROWS):
                # A cell hit by two documents of this task is listed twice; a third hit adds nothing.
                cell, n = np.unique(_cells(piece, row), return_counts=True)
                cell = np.repeat(cell, np.minimum(n, 2))
                part = (cell >> np.uint64(SLICE_BITS)).astype(np.int64)
                low = (cell & np.uint64((1 << SLICE_BITS) - 1)).astype(np.uint32)
                edge = np.flatnonzero(np.diff(part, prepend=-1))
                parts = np.split(low, edge[1:])
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(edge), pa.int32()), pa.array(part[edge], pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], schema=schema)

        held = 0
        for batch in batches:
            for _, words in W.chunks(batch.column(0), breaks):
                _, _, piece, row, _ = _filed(words, size, gram)
                if len(piece):
                    order = np.lexsort((piece, row))
                    piece, row = piece[order], row[order]
                    keep = np.ones(len(piece), bool)  # once a document
                    keep[1:] = (np.diff(piece) != 0) | (np.diff(row) != 0)
                    seen.append(piece[keep])
                    held += int(keep.sum())
            if held > 1 << 20:
                yield from flush()
                held = 0
        if seen:
            yield from flush()

    return run


def _merge(batches):
    """Adds up the cells of each slice; bits of the cells hit twice, compressed, and how many. Rows come slice by slice."""
    import zstandard

    schema = pa.schema([("row", pa.int32()), ("slice", pa.int32()), ("taken", pa.int64()), ("bits", pa.binary())])
    small = zstandard.ZstdCompressor(level=1)
    at, have = None, np.zeros(1 << SLICE_BITS, np.uint8)

    def done():
        bits = have > 1
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*at, int(bits.sum()), small.compress(np.packbits(bits).tobytes())), schema.types, strict=True)], schema=schema)

    for batch in batches:
        for row, part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if at is not None and at != (row, part):
                yield done()
                have[:] = 0
            at = row, part
            cell, n = np.unique(np.frombuffer(cells.as_buffer(), np.uint32), return_counts=True)
            have[cell] = np.minimum(have[cell] + n.astype(np.uint8), 2)
    if at is not None:
        yield done()


def sketch(docs: DataFrame, size: int, gram: int) -> list[bytes]:
    """ROWS bit strings of equal length, a power of two: the cells that two documents hit.

    A cell of a folded row is taken if any of the cells folded into it is, so no
    cell that two documents hit is lost.
    """
    import zstandard

    partial = docs.select("text").mapInArrow(tidied(_partial_sketch(size, gram)), "row int, slice int, cells binary")
    ordered = partial.repartition("row", "slice").sortWithinPartitions("row", "slice")
    merged = written(ordered.mapInArrow(tidied(_merge), "row int, slice int, taken long, bits binary"), "sketch")
    most = max((x["taken"] for x in merged.groupBy("row").agg(F.sum("taken").alias("taken")).collect()), default=0)
    bits = next((b for b in range(SLICE_BITS, CELL_BITS) if most * SPARE <= 1 << b), CELL_BITS)
    slices, width, large = 1 << (bits - SLICE_BITS), 1 << (SLICE_BITS - 3), zstandard.ZstdDecompressor()
    rows = [np.zeros(slices * width, np.uint8) for _ in range(ROWS)]
    for x in merged.filter("taken > 0").toLocalIterator():  # ROWS * 2**(CELL_BITS - SLICE_BITS) rows of a megabyte at most
        at = x["slice"] % slices * width
        rows[x["row"]][at : at + width] |= np.frombuffer(large.decompress(x["bits"]), np.uint8)
    return [r.tobytes() for r in rows]


def _repeated(piece: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    found = np.ones(len(piece), bool)
    for row, b in enumerate(bits):
        cell = _cells(piece, row) & np.uint64(8 * len(b) - 1)
        found &= (b[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 > 0
    return found


RUNS = "doc_id long, text_key long, first int, n int, piece long, span long, windows array<long>"


def _runs(size: int, gram: int, sent):
    breaks = W.white_space()

    def run(batches):
        bits = [np.frombuffer(x, np.uint8) for x in sent.value]
        for batch in batches:
            ids, keys = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in (0, 1))
            for low, words in W.chunks(batch.column(2), breaks):
                first, n, piece, row, windows = _filed(words, size, gram)
                keep = _repeated(piece, bits)
                first, n, piece, row = first[keep], n[keep], piece[keep], row[keep]
                if not len(first):
                    continue
                offsets = np.concatenate([[0], np.cumsum(n)])
                k = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
                at = np.repeat(first, n) + k
                # Windows scrambled with their places add up to the run's hash.
                span = W.mix(np.add.reduceat(W.mix(windows[at] ^ W.mix(k.astype(np.uint64), 9), 13), offsets[:-1]) + n.astype(np.uint64), 15)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[low + row], pa.int64()), pa.array(keys[low + row], pa.int64()), pa.array(first - words.first[row], pa.int32()), pa.array(n, pa.int32()), pa.array(piece.view(np.int64)), pa.array(span.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(windows[at].view(np.int64)))],
                    names=["doc_id", "text_key", "first", "n", "piece", "span", "windows"],
                )

    return run


def repeated_spans(docs: DataFrame, size: int = 50, gram: int = 16) -> DataFrame:
    """(doc_id, text_key, a, b): words a..b-1 are covered by windows that a smaller doc_id has.

    Runs of windows that are equal as a whole are settled by the least doc_id of
    that run. Only the first document of each distinct run can still hold
    windows of an even earlier document, and only where one piece has several
    runs; those are compared window by window.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").filter("doc_id is not null and text is not null")
    sent = docs.sparkSession.sparkContext.broadcast(sketch(docs, size, gram))
    runs = written(docs.mapInArrow(tidied(_runs(size, gram, sent)), RUNS), "runs")
    least = written(runs.groupBy("piece", "span").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "least")
    several = written(least.groupBy("piece").agg(F.count("*").alias("spans")).filter("spans > 1").select("piece"), "several")
    again = least.filter("least < most").select("piece", "span", "least")
    later = runs.select("doc_id", "text_key", "first", "n", "piece", "span").join(again, ["piece", "span"]).filter("doc_id > least").select("doc_id", "text_key", F.col("first").alias("a"), (F.col("first") + F.col("n") + (size - 1)).alias("b"))
    heads = runs.join(least.join(several, "piece", "left_semi").select("piece", "span", F.col("least").alias("doc_id")), ["piece", "span", "doc_id"], "left_semi")
    single = heads.select("doc_id", "text_key", "piece", "first", F.posexplode("windows").alias("k", "window"))
    known = single.groupBy("piece", "window").agg(F.min("doc_id").alias("least"))
    edge = single.join(known, ["piece", "window"]).filter("doc_id > least").select("doc_id", "text_key", (F.col("first") + F.col("k")).alias("a"), (F.col("first") + F.col("k") + size).alias("b"))
    return later.unionByName(edge)


def _apply(batches):
    for batch in batches:
        out: dict = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")}
        for doc_id, text, cuts in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)), batch.column(2), strict=True):
            words = (text or b"").split()
            total = len(words)
            if cuts.is_valid and len(cuts.values):
                a = np.asarray(cuts.values.field(0))
                b = np.asarray(cuts.values.field(1))
                cover = np.zeros(total + 1, np.int32)
                np.add.at(cover, a, 1)
                np.add.at(cover, b, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
            kept = b" ".join(words)
            for k, v in zip(out, (doc_id, total, total - len(words), hashlib.sha256(kept).hexdigest(), kept if len(words) < total else None), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, size: int = 50, gram: int = 16) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (null where nothing was removed) of every row.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; a null or empty text has
    none and the digest of no bytes. Rows without doc_id are neither earlier nor
    later than any other and stay whole. Rows that repeat a doc_id are judged each
    by its own text, and never against one another. Extra columns are ignored.
    """
    cuts = repeated_spans(docs, size, gram).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("a", "b")).alias("cuts")).withColumnsRenamed({"doc_id": "cut_id", "text_key": "cut_key"})
    rows = packed(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), "doc_id", "text_key")
    joined = rows.join(cuts, (rows.doc_id == cuts.cut_id) & (rows.text_key == cuts.cut_key), "left")
    return joined.select("doc_id", "packed", "cuts").mapInArrow(tidied(_apply), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


#: The digests of remove_repeats over the table documents, for DuckDB.
SQL = """
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM split WHERE len(words) >= 50)),
first AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM windows JOIN first USING (h) WHERE least < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM split),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT split.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept ON split.doc_id = kept.doc_id"""
