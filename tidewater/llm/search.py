"""Ranked lexical search of a set of items over all documents, by sort-based accumulation.

Items are taken in blocks, so that what a task gets with them is bounded. For a
block, one pass over the texts keeps of each document its length and the places
and counts of those of its terms that the block has; document frequencies follow
from that table. A second pass, over that table only, concatenates for a run of
documents the arrays (item, document, impact) of all matches, radix-sorts their
packed keys and sums impacts of equal keys by reduceat. A heap an item keeps a
task's best documents; the best of all tasks are ranked by Spark, in two steps.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import tidied, written

#: A term's weight is a thousand times a logarithm; its impact saturates with its count, the more so the longer the document.
WEIGHT, PERCENT, IMPACT, TIMES, LONG = 1000, 25, 10**9, 1000, 12
#: Bytes of item text in a block (at least one item), matches that are sorted at once, and groups that tasks' lists are merged in first.
BLOCK_BYTES, MATCHES, GROUPS = 8 << 20, 1 << 21, 256
#: Ranks after all ids: a document without one.
LAST = (1 << 63) - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _terms(column, limit: int = W.CHUNK_BYTES):
    """(first row, Words) for runs of rows: the terms of each text, A-Z lower-cased."""
    data, offsets = W.buffers(column)
    breaks, low = W.not_alphanumeric(), 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, W.Words(lowered(data[offsets[low] : offsets[high]]), offsets[low : high + 1] - offsets[low], breaks)
        low = high


class Block:
    """The items of a block as an inverted index: for each distinct term, ascending by hash, its items and how often each has it."""

    def __init__(self, texts: list[str | None]):
        item, term = [], []
        for low, words in _terms(pa.array(texts, pa.string())):
            item.append(low + words.row())
            term.append(words.hash)
        item = np.concatenate(item) if item else np.zeros(0, np.int64)
        term = np.concatenate(term) if term else np.zeros(0, np.uint64)
        order = np.lexsort((item, term))
        item, term = item[order], term[order]
        head = np.flatnonzero(np.append(True, (np.diff(item) != 0) | (np.diff(term) != 0))[: len(item)])
        self.item, self.times = item[head], np.diff(np.append(head, len(item)))
        self.terms, self.begin, self.many = np.unique(term[head], return_index=True, return_counts=True)

    def __len__(self) -> int:
        return len(self.terms)


MATCHED = "rank_id long, doc_id long, n long, terms array<int>, counts array<int>"


def _matched(terms: np.ndarray):
    """For each document its number of terms, and places in `terms` with counts."""

    def run(batches):
        for batch in batches:
            for low, words in _terms(batch.column(1)):
                row = words.row()
                at = np.searchsorted(terms, words.hash)
                at[at == len(terms)] = 0
                hit = np.flatnonzero(terms[at] == words.hash) if len(terms) else np.zeros(0, np.int64)
                key, count = np.unique(row[hit] * np.int64(len(terms)) + at[hit], return_counts=True)
                size = np.bincount(key // max(len(terms), 1), minlength=len(words.first))
                offsets = pa.array(np.append(0, np.cumsum(size)), pa.int32())
                ids = batch.column(0).slice(low, len(words.first))
                yield pa.RecordBatch.from_arrays(
                    [ids.fill_null(LAST), ids, pa.array(words.count, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(key % max(len(terms), 1), pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32()))],
                    names=["rank_id", "doc_id", "n", "terms", "counts"],
                )

    return run


def _frequencies(many: int):
    """A task's number of documents for each place of a term."""

    def run(batches):
        total = np.zeros(many, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=many)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "docs"])

    return run


def radix_order(key: np.ndarray) -> np.ndarray:
    """The stable ascending order of non-negative keys, by digits of 16 bits from the lowest; numpy sorts such digits by radix."""
    order, top, shift = None, int(key.max(initial=0)), 0
    while order is None or top >> shift:
        digit = ((key if order is None else key[order]) >> shift).astype(np.uint16)
        step = np.argsort(digit, kind="stable")
        order = step if order is None else order[step]
        shift += 16
    return order


def accumulated(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score), ascending: impacts summed over equal pairs of item and doc (below `docs`)."""
    key = item * np.int64(docs) + doc
    order = radix_order(key)
    key = key[order]
    head = np.flatnonzero(np.append(True, np.diff(key) != 0)[: len(key)])
    score = np.add.reduceat(impact[order], head) if len(head) else impact[:0]
    return key[head] // docs, key[head] % docs, score


def _runs_of_matches(work: np.ndarray):
    """Ranges of documents with about MATCHES matches, at least one document each."""
    ends, low = np.append(0, np.cumsum(work)), 0
    while low < len(work):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + MATCHES, "right")) - 1)
        yield low, high
        low = high


BEST = "item int, rank_id long, doc_id long, score long"


def _best(block: Block, weight: np.ndarray, documents: int, total: int, top: int):
    """A task's `top` documents of each item."""

    def run(batches):
        heaps: dict[int, list] = {}
        least = np.ones(int(block.item.max(initial=-1)) + 1, np.int64)  # what a document must score to be looked at
        for batch in batches:
            ids, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            long = LONG * (100 - PERCENT + (PERCENT * n * documents) // max(total, 1))
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            terms, counts = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
            starts = np.append(0, np.cumsum(size))
            work = np.add.reduceat(np.append(block.many[terms], 0), np.minimum(starts[:-1], len(terms))) * (size > 0) if len(size) else size
            for low, high in _runs_of_matches(work):
                part = slice(starts[low], starts[high])
                own, doc = terms[part], np.repeat(np.arange(high - low), size[low:high])
                tf = counts[part].astype(np.int64)
                value = weight[own] * ((IMPACT * tf) // (TIMES * tf + long[low:high][doc]))
                many = block.many[own]
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(block.begin[own], many)
                item, where, score = accumulated(block.item[at], np.repeat(doc, many), np.repeat(value, many) * block.times[at], high - low)
                keep = np.flatnonzero(score >= least[item])
                item, where, score = item[keep], low + where[keep], score[keep]
                order = np.lexsort((ids[where], -score, item))
                item, where, score = item[order], where[order], score[order]
                nth = np.arange(len(item)) - np.searchsorted(item, item)
                for i, w, s in zip(*(x[nth < top].tolist() for x in (item, where, score)), strict=True):
                    heap, new = heaps.setdefault(i, []), (s, -int(ids[w]))
                    if len(heap) < top:
                        heapq.heappush(heap, new)
                    elif new > heap[0]:
                        heapq.heapreplace(heap, new)
                    if len(heap) == top:
                        least[i] = heap[0][0]
        rows = [(i, -d, s) for i, heap in heaps.items() for s, d in heap]
        item, doc, score = ([r[k] for r in rows] for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array([None if d == LAST else d for d in doc], pa.int64()), pa.array(score, pa.int64())], names=["item", "rank_id", "doc_id", "score"])

    return run


def _first(rows: DataFrame, top: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "rank_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def _ranked(docs: DataFrame, items: list, top: int) -> DataFrame:
    """The best documents of a block of items (item_id, text)."""
    spark, block = docs.sparkSession, Block([x["text"] for x in items])
    matched = written(docs.select("doc_id", "text").mapInArrow(tidied(_matched(block.terms)), MATCHED), "matched")
    size = matched.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("total")).first()
    documents, total = size["documents"], size["total"] or 0
    weight = np.zeros(len(block), np.int64)
    for row in matched.select("terms").mapInArrow(_frequencies(len(block)), "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect():  # one row a term of the block
        weight[row["term"]] = math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * row["docs"] + 1)))
    best = matched.filter("size(terms) > 0").select("rank_id", "n", "terms", "counts").mapInArrow(tidied(_best(block, weight, documents, total, top)), BEST)
    best = best.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    ranked = _first(_first(best, top, "item", "group").drop("rank"), top, "item")
    names = spark.createDataFrame([(i, x["item_id"]) for i, x in enumerate(items)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's `top` highest-scoring documents, those with score 0 left out.

    A null or empty text has no terms: such an item has no rows, such a document
    is in none and in no count. Every row of docs is a document of its own, also
    if it repeats a doc_id, and every row of items an item. Equal scores go by
    ascending doc_id, null last. Extra columns are ignored; empty tables give no
    rows.
    """
    items = items.select("item_id", "text").filter("text is not null")
    bytes_ = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-bytes_ // block_bytes)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(blocks):
        # About block_bytes of text: what the driver and each task hold.
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        if own:
            one = _ranked(docs, own, top)
            out = out.unionByName(written(one, "ranked") if blocks > 1 else one)
    return out


#: search over the tables documents and benchmark, for DuckDB.
SQL = """
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
wanted AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, corpus GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total)))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), corpus GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20"""
