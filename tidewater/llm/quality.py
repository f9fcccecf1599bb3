"""Supervised subword embeddings that score the quality of a text.

Features are words, pairs of neighbouring words (and one that says they are equal) and runs of 3 to 5 bytes of a
word (with the white space before and after it), hashed to buckets. A document
is the average of its features' vectors; a softmax layer gives the score. The
model is trained on the driver by stochastic gradient descent over a sample of
labelled documents whose size is bounded; only bucket counts get there, never
texts. For scoring, each bucket's vector is folded into one number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import tidied

BUCKET_BITS, DIMENSIONS, EPOCHS, RATE, SEED = 16, 16, 12, 0.4, 7
#: Labelled documents of each class that are learned from, at most.
SAMPLE = 1000
#: Texts of more bytes are scored but not learned from, which bounds what the driver gets (160 KB a text).
LONGEST = 1 << 14
THRESHOLD = 0.7
GRAMS = (3, 4, 5)
#: Bytes of text whose features a worker holds at once, about.
CHUNK = 1 << 17
#: The bucket of a word that follows itself.
TWICE = 0


def _features(words: W.Words, breaks: np.ndarray):
    """(first feature place, bucket) lists: buckets and the text each belongs to, in pieces."""
    down = np.uint64(64 - BUCKET_BITS)
    row = words.row()
    yield row, W.mix(words.hash, 31) >> down
    if len(words) > 1:
        pair = words.hash[:-1] * W.U(0xC2B2AE3D27D4EB4F) + words.hash[1:]
        same = row[:-1] == row[1:]
        yield row[:-1][same], W.mix(pair[same], 37) >> down
        # A word after itself is one feature whatever the word, for texts that repeat words never seen before.
        twice = row[:-1][same & (words.hash[:-1] == words.hash[1:])]
        yield twice, np.full(len(twice), TWICE, np.uint64)
    data = np.where(breaks[words.data], np.uint8(0x20), words.data)
    blocks = W.eight(data)
    # From each byte of a word, and from the break before it, up to the break after it.
    until = np.repeat(np.minimum(words.end + 1, words.offsets[row + 1]), words.end - words.start)
    at = np.arange(len(until)) - np.repeat(np.cumsum(words.end - words.start) - (words.end - words.start), words.end - words.start) + np.repeat(words.start, words.end - words.start)
    ahead = words.start > words.offsets[row]
    text = np.repeat(row, words.end - words.start)
    at, until, text = np.concatenate([at, words.start[ahead] - 1]), np.concatenate([until, np.minimum(words.end + 1, words.offsets[row + 1])[ahead]]), np.concatenate([text, row[ahead]])
    for n in GRAMS:
        ok = at + n <= until
        here = at[ok]
        yield text[ok], W.mix(blocks[here] & W.LOWEST[n], n) >> down


def _counts(batches):
    breaks = W.white_space()
    for batch in batches:
        for low, words in W.chunks(batch.column(1), breaks, 1 << 18):
            n = len(words.first)
            pieces = [(r.astype(np.uint64) << np.uint64(BUCKET_BITS)) | b for r, b in _features(words, breaks)]
            key, count = np.unique(np.concatenate(pieces), return_counts=True)
            per = np.bincount((key >> np.uint64(BUCKET_BITS)).astype(np.int64), minlength=n)
            offsets = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
            bucket = (key & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), pa.ListArray.from_arrays(offsets, pa.array(bucket)), pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))], names=["label", "buckets", "counts"])


def train(labels: list[int], buckets: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """(a number for each bucket, the bias): log odds of label 1 are the average of a text's numbers plus the bias.

    Steps are divided by the squared length of a text's averaging weights, so that
    long and short texts move the score alike. Without both labels all is zero.
    """
    vectors = np.random.default_rng(SEED).normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    out = np.random.default_rng(SEED + 1).normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    if len(set(labels)) < 2:
        return np.zeros(1 << BUCKET_BITS, np.float32), 0.0
    weights = [c / c.sum() if len(c) else c.astype(float) for c in counts]
    order = np.random.default_rng(SEED + 2)
    steps, done = EPOCHS * len(labels), 0
    for _ in range(EPOCHS):
        for i in order.permutation(len(labels)):
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(buckets[i]):
                continue
            own, w = vectors[buckets[i]], weights[i].astype(np.float32)
            mean = w @ own
            logit = mean @ out + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.05 * rate * p
            vectors[buckets[i]] = own - (rate / float(w @ w)) * np.outer(w, back)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id):
    """True for rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model, from at most about `sample` labelled rows of each class, chosen by a hash of doc_id, those with texts of up to LONGEST bytes."""
    short = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).select("doc_id", "text")
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    sizes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, min(1.0, sample / max(1, sizes.get(1, 0)))).otherwise(min(1.0, sample / max(1, sizes.get(0, 0))))
    chosen = usable.filter((F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) / float(1 << 20)) < share)
    # About 2 * sample rows, so their ids can be sent everywhere; the texts stay where they are.
    rows = short.join(F.broadcast(chosen), "doc_id").select("label", "text", F.xxhash64("doc_id", F.lit(SEED)).alias("rank"))
    found = rows.select("label", "text", "rank").select("label", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidied(_counts), "label int, buckets array<int>, counts array<int>").toArrow()
    label, bucket, count = ([x.as_py() if k == 0 else np.asarray(x.values) for x in found.column(k)] for k in range(3))
    order = sorted(range(len(label)), key=lambda i: (label[i], len(bucket[i]), bucket[i].tobytes()))
    return train([label[i] for i in order], [bucket[i] for i in order], [count[i] for i in order])


def _scores(batch_texts, numbers: np.ndarray, bias: float) -> np.ndarray:
    breaks = W.white_space()
    out = []
    for _, words in W.chunks(batch_texts, breaks, CHUNK):
        n = len(words.first)
        total, many = np.zeros(n), np.zeros(n)
        for row, bucket in _features(words, breaks):
            total += np.bincount(row, numbers[bucket.astype(np.int64)], n)
            many += np.bincount(row, minlength=n)
        out.append(1 / (1 + np.exp(-np.clip(total / np.maximum(many, 1) + bias, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def _kept(batch: pa.RecordBatch, at: int, model: tuple[np.ndarray, float], threshold: float):
    """The accepted rows of a batch, some rows at a time, so that no second copy of all is made; `at` is the place of its texts."""
    for low in range(0, batch.num_rows, 256):
        part = batch.slice(low, 256)
        yield part.filter(pa.array(_scores(part.column(at), *model) >= threshold))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A null or empty text has no features and scores by the bias alone. Rows
    without doc_id are scored and never held out. Repeated rows score alike.
    Extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), *sent.value), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score at least the threshold.

    A null or empty text scores by the bias alone; repeated rows stay or go together;
    an empty table gives no rows. Columns of docs may have any other names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield from _kept(batch, at, sent.value, threshold)

    return docs.mapInArrow(tidied(run), docs.schema)
