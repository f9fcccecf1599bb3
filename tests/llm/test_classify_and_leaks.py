import random

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import leaks, quality
from tidewater.llm.queries import table


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in scored if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in scored)


def test_held_out_is_crc32(spark):
    import zlib

    from pyspark.sql import functions as F

    df = spark.range(200).select(F.col("id").alias("doc_id")).select("doc_id", quality.held_out(F.col("doc_id")).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())


def test_fold_equals_softmax():
    rng = np.random.default_rng(0)
    buckets = [rng.choice(1 << 16, 30, replace=False) for _ in range(20)]
    counts = [rng.integers(1, 4, 30) for _ in range(20)]
    numbers, bias = quality.train([i % 2 for i in range(20)], buckets, counts)
    odds = [float(numbers[b] @ (c / c.sum())) + bias for b, c in zip(buckets, counts)]
    assert all((o > 0) == (i % 2 == 1) for i, o in enumerate(odds))


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (6, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 4)}) == 1
    assert quality.score(empty, model).count() == 0
    assert quality.accepted(odd, model).columns == odd.columns
    nothing = quality.fit(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, nothing).collect()} == {0.5}


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def planted(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(16, 60))] for _ in range(20)]
    rows, truth = [], {}
    for i in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 400))]
        if i % 4 == 0:
            k = rng.randrange(20)
            passage = list(items[k])
            for at in rng.sample(range(len(passage)), len(passage) // 10):
                passage[at] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in passage] if i % 8 == 0 else passage
            truth[i] = k
        rows.append((i, " ".join(words), "s"))
    return [(k, " ".join(x)) for k, x in enumerate(items)], rows, truth


@pytest.mark.parametrize("block_bytes", [1 << 25, 600])
def test_leaks_with_changed_words(spark, docs_of, monkeypatch, block_bytes):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", block_bytes)
    items, rows, truth = planted()
    docs = docs_of(rows)
    got = {r.doc_id: r.item_ids for r in leaks.find_leaks(docs, benchmark(spark, items)).collect() if r.contaminated}
    assert got == {i: [k] for i, k in truth.items()}
    kept = leaks.without_leaks(docs, benchmark(spark, items))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, _, _ in rows if i not in truth]


def test_leaks_odd_rows(spark, odd, empty):
    items = benchmark(spark, [(1, "one"), (2, None), (None, "x"), (3, ""), (4, "no id at all here now and more of it")])
    got = leaks.find_leaks(odd, items).collect()
    assert len(got) == odd.count() and [r.doc_id for r in got if r.contaminated] == [3]
    assert leaks.find_leaks(empty, items).count() == 0
    assert not any(r.contaminated for r in leaks.find_leaks(odd, items.limit(0)).collect())


def test_longest_stretch_like_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        same = rng.random(rng.integers(0, 60)) < rng.choice([0.6, 0.75, 0.85])
        every = [(j - i, -i) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 5 * same[i:j].sum() >= 4 * (j - i)]
        begin, end = leaks._longest(same)
        assert (end - begin, -begin) == max(every, default=(0, 0))


def test_passages_between_changed_words(spark, docs_of):
    item = [f"w{i}" for i in range(46)]
    words = [f"new{i}" if 12 <= i < 17 or 29 <= i < 34 else w for i, w in enumerate(item)]
    rows = [(1, " ".join(words), "s"), (2, " ".join(w if i % 2 else "x" for i, w in enumerate(item)), "s")]
    assert [r.contaminated for r in leaks.find_leaks(docs_of(rows), benchmark(spark, [(7, " ".join(item))])).orderBy("doc_id").collect()] == [True, False]


def test_repeated_words_stay_small(spark, docs_of):
    """A text of one repeated word meets an item of it on as many diagonals as places, not on their product."""
    import pyarrow as pa

    index = leaks.Index([7], pa.array(["same " * 400]))
    ((_, words),) = leaks.W.chunks(leaks._lower(pa.array(["same " * 12000])), leaks.W.not_alphanumeric())
    diagonals = index._diagonals(words, words.row())
    assert len(diagonals) < 12400 + 4 * len(leaks.MASKS)
    assert index.hits(words)[0][7][1] - index.hits(words)[0][7][0] == 400


def brute_leaks(items, text):
    """Items some stretch of which, on one diagonal, has LEAST_WORDS words and LEAST_EQUAL of them equal; by every pair of places."""
    import re

    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())
    doc, out = words(text), set()
    for i, item in items:
        item = words(item)
        for start in range(1 - len(item), len(doc)):
            same = [doc[start + k] == item[k] for k in range(len(item)) if 0 <= start + k < len(doc)]
            need = min(leaks.LEAST_WORDS, len(item))
            if any(sum(same[a:b]) >= leaks.LEAST_EQUAL * (b - a) for a in range(len(same)) for b in range(a + need, len(same) + 1)):
                out.add(i)
    return out


def test_leaks_like_brute_force(spark, docs_of):
    items, rows, _ = planted(9)
    rows = [(i, " ".join(t.split()[:150]), s) for i, t, s in rows[:40]]
    got = {r.doc_id: set(r.item_ids) for r in leaks.find_leaks(docs_of(rows), benchmark(spark, items)).collect()}
    for i, text, _ in rows:
        assert got[i] == brute_leaks(items, text)


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 20, 24, 25, 30, 40])
def test_no_passage_of_the_least_share_is_lost(n):
    """Every way to change as many words as the rule allows (or 400 of them), inside a longer text."""
    import itertools
    import math

    import pyarrow as pa

    rng, k = random.Random(n), int(n * (1 - leaks.LEAST_EQUAL) + 1e-9)
    ways = list(itertools.combinations(range(n), k)) if math.comb(n, k) < 3000 else [tuple(rng.sample(range(n), k)) for _ in range(400)]
    index = leaks.Index([7], pa.array([" ".join(f"w{i}" for i in range(n))]))
    texts = [" ".join(["before"] * 3 + [f"x{i}" if i in gone else f"w{i}" for i in range(n)] + ["after"] * 3) for gone in ways]
    found = 0
    for _, words in leaks.W.chunks(leaks._lower(pa.array(texts)), leaks.W.not_alphanumeric()):
        hits = index.hits(words)
        found += len(hits)
        assert all(h[7][1] - h[7][0] >= min(n, leaks.LEAST_WORDS) for h in hits.values())
    assert found == len(ways)
    more = [" ".join(f"x{i}" if i < k + 1 else f"w{i}" for i in range(n))]  # at one end, a word more: too few equal if it must be whole
    if n < leaks.LEAST_WORDS:
        ((_, words),) = leaks.W.chunks(leaks._lower(pa.array(more)), leaks.W.not_alphanumeric())
        assert not index.hits(words)


def test_an_index_is_made_once_for_all_that_is_held(monkeypatch):
    import pyarrow as pa

    made, real = [], leaks.Index
    items, rows, truth = planted()

    def blocks():
        for low in range(0, 20, 5):
            made.append(low)
            yield real([k for k, _ in items[low : low + 5]], pa.array([t for _, t in items[low : low + 5]]))

    batches = [pa.record_batch([pa.array([t])], names=["text"]) for _, t, _ in rows]
    found = [sorted(h.get(0, {})) for _, h in leaks._with_hits(iter(batches), 0, blocks)]
    assert len(made) == 4 and [i for i, f in enumerate(found) if f] == sorted(truth)
    monkeypatch.setattr(leaks, "HELD_BYTES", 1)
    assert [sorted(h.get(0, {})) for _, h in leaks._with_hits(iter(batches), 0, blocks)] == found and len(made) == 4 + 4 * len(rows)


def test_filters_on_odd_rows(spark, odd, empty):
    items = benchmark(spark, [(4, "no id at all here now and more of it")])
    key = lambda r: str(tuple(r))
    assert sorted(map(key, leaks.without_leaks(odd, items).collect())) == sorted(map(key, odd.collect()))
    assert leaks.without_leaks(empty, items).count() == 0
    bias = (np.zeros(1 << quality.BUCKET_BITS, np.float32), 5.0)
    assert sorted(map(key, quality.accepted(odd, bias).collect())) == sorted(map(key, odd.collect()))
    assert quality.accepted(odd, (bias[0], -5.0)).count() == 0 and quality.accepted(empty, bias).count() == 0


def test_training_like_plain_gradient_descent():
    """The folded numbers against a softmax model trained by the textbook's loops."""
    rng = np.random.default_rng(5)
    labels = [i % 2 for i in range(6)]
    buckets = [rng.choice(1 << quality.BUCKET_BITS, 8, replace=False) for _ in labels]
    counts = [rng.integers(1, 4, 8) for _ in labels]
    numbers, bias = quality.train(labels, buckets, counts)
    vectors = np.random.default_rng(quality.SEED).normal(0, 0.1, (1 << quality.BUCKET_BITS, quality.DIMENSIONS))
    out = np.random.default_rng(quality.SEED + 1).normal(0, 0.5, (quality.DIMENSIONS, 2))
    b, order, done = np.zeros(2), np.random.default_rng(quality.SEED + 2), 0
    for _ in range(quality.EPOCHS):
        for i in order.permutation(len(labels)):
            rate = quality.RATE * (1 - done / (quality.EPOCHS * len(labels)))
            done += 1
            w = counts[i] / counts[i].sum()
            mean = sum(x * vectors[k] for x, k in zip(w, buckets[i]))
            e = [np.exp(mean @ out[:, c] + b[c]) for c in (0, 1)]
            error = [e[c] / sum(e) - (labels[i] == c) for c in (0, 1)]
            back = error[0] * out[:, 0] + error[1] * out[:, 1]
            for c in (0, 1):
                out[:, c] -= rate * error[c] * mean
                b[c] -= 0.05 * rate * error[c]
            for x, k in zip(w, buckets[i]):
                vectors[k] -= rate * x / sum(w * w) * back
    some = np.unique(np.concatenate(buckets))
    assert np.allclose(numbers[some], vectors[some] @ (out[:, 1] - out[:, 0]), atol=1e-3) and abs(bias - (b[1] - b[0])) < 1e-3


def test_long_texts_are_scored_but_not_learned_from(spark, docs_of, monkeypatch):
    monkeypatch.setattr(quality, "LONGEST", 50)
    docs = docs_of([(i, ("good words here" if i % 2 else "junk junk bad") + " more" * (50 if i > 40 else 0), "s") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    short = quality.fit(docs.filter("doc_id <= 40"), labels.filter("doc_id <= 40"))
    assert quality.score(docs, quality.fit(docs, labels)).count() == 60
    assert np.array_equal(quality.fit(docs.filter("doc_id <= 40"), labels.filter("doc_id <= 40"))[0], short[0])


def test_accepted_rows_take_little_memory():
    """A batch of 8 MB: its features and the rows kept are made for some texts at a time, and no row is lost."""
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 117, 4096))).replace("e", " ") for _ in range(2000)] + [None, "", "x" * 300000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    numbers = rng.normal(0, 1, 1 << quality.BUCKET_BITS).astype(np.float32)
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    kept, most = [], 0
    for part in quality._kept(batch, 1, (numbers, 0.0), 0.5):
        most = max(most, pa.total_allocated_bytes() - before)
        kept += part.column(0).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < len(kept) < len(texts) and kept == np.flatnonzero(quality._scores(batch.column(1), numbers, 0.0) >= 0.5).tolist()
    assert most < 4 << 20 and peak < 30 << 20, (most, peak)
