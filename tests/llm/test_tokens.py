import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import queries, scratch, tokens

PATH = queries.tokenizer_path()
ODD_TEXTS = ["it's o'clock 'shop we'll", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΟΔΟΣ ΣΊΣΥΦΟΣ", "İstanbul İ été a b x", "\x1c\x1d a\x00b \x7f \x85", "日本語 テスト123 ½ ²³ ª º µ ÷ × ÿ Ÿ ß ẞ ſ", "😀😀 a😀b ​ ́x ̀", "12 3a4 %%%### $5.00", "ÀÉ É̀", "a\tb\nc\x0bd\x0ce\rf", "﻿bom", "", None]


ENCODER = tokens.Encoder(PATH)


def check(texts):
    encode = ENCODER
    got = []
    for _, ids, sizes in encode(pa.array(texts, pa.string())):
        got += np.split(ids, np.cumsum(sizes)[:-1])
    want = encode.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [x.tolist() for x in got] == [x.ids for x in want]


def test_ids_of_odd_texts():
    check(ODD_TEXTS)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aBé'É1 <|\n.,!", max_size=40)), min_size=1, max_size=5))
def test_ids_like_the_library(texts):
    check([t.encode("utf-8", "ignore").decode() for t in texts])


def test_frames_round_trip_and_find_damage():
    ids = np.array([1, 5, 49407], np.uint16)
    record = tokens.frame(7, ids)
    doc_id, back = tokens.unframe(record)
    assert doc_id == 7 and back.tolist() == ids.tolist()
    assert tokens.unframe(tokens.frame(None, ids))[0] is None
    for at in range(len(record)):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            tokens.unframe(bytes(bad))


def test_a_damaged_length_is_not_read_by():
    head = (1 << 62).to_bytes(8, "little") + bytes(4)
    with pytest.raises(ValueError, match="length"):
        tokens.payload_size(head)
    assert tokens.payload_size(tokens.frame(1, np.array([3], np.uint16))[:12]) > 9


def test_starts_over_many_tasks_and_shards(spark, docs_of, monkeypatch):
    """Tasks follow the bytes of text where the session has fewer partitions; starts go on from task to task."""
    monkeypatch.setattr(tokens, "SHARD_BYTES", 150)
    monkeypatch.setattr(tokens, "PART_BYTES", 400)
    rows = [(i, f"text {i} of many " * 4, "s") for i in range(200)]
    path = scratch.place(spark, "many")
    got = sorted(tuple(r)[:3] for r in tokens.encode_documents(docs_of(rows), PATH, path).collect())
    assert [s for _, s, _ in got] == np.cumsum([0, *(n for *_, n in got)])[:-1].tolist()
    shards = spark.read.parquet(f"{path}/shards").collect()
    assert len({s.part for s in shards}) > 20 and max(s.piece for s in shards) > 0


def test_files_hold_what_was_encoded(spark, docs_of, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_BYTES", 200)
    rows = [(i * 3, " ".join(["word", "È", "x1"] * (i % 7)), "s") for i in range(60)][::-1]
    docs = docs_of(rows)
    path = scratch.place(spark, "test")
    got = sorted(tuple(r) for r in tokens.encode_documents(docs, PATH, path).collect())
    library, start, want = ENCODER.library, 0, []
    for i, text, _ in sorted(rows):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    shards = spark.read.parquet(f"{path}/shards").collect()
    assert len(shards) > 3 and sum(s.records for s in shards) == 60
    some = max(shards, key=lambda s: s.records)
    order = list(range(some.records))[::-1]
    assert [i for i, _ in tokens.read_ids(path, some.shard, order)] == sorted((i for i, _ in tokens.read_ids(path, some.shard, sorted(order))), reverse=True)


def test_odd_rows(odd, empty):
    got = tokens.encode_documents(odd, PATH).collect()
    assert len(got) == odd.count() and min(r.start for r in got) == 0
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 4)} == {1}
    assert next(r for r in got if r.doc_id is None).start == 0
    assert tokens.encode_documents(empty, PATH).count() == 0


def test_words_that_agree_under_polynomial_hashes():
    for n in (1024, 2048, 4096):
        one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        check([one, one.translate(str.maketrans("ab", "ba")), one])


def test_parts_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens.W, "hashed", lambda data, start, end: np.zeros(len(start), np.uint64))
    encode = tokens.Encoder(PATH)
    texts = ["one two three", "three two seventeen and a longer wordlikethis1", "wordlikethat two", "日本 'x one"]
    for _ in range(2):
        got = []
        for _, ids, sizes in encode(pa.array(texts)):
            got += np.split(ids, np.cumsum(sizes)[:-1])
        assert [x.tolist() for x in got] == [x.ids for x in encode.library.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    monkeypatch.setattr(tokens.W, "CHUNK_BYTES", 40)
    check([" ".join(f"w{i * j}" for j in range(9)) for i in range(30)])


def test_a_task_that_runs_again_leaves_one_result(spark, docs_of, tmp_path):
    """Every task fails once after its first shard is written; the files of that attempt are no part of the result."""
    rows = [(i, f"text {i} " * 30, "s") for i in range(40)]
    docs, real, mark = docs_of(rows), tokens.write_records, str(tmp_path)
    path = scratch.place(spark, "again")
    real(docs, PATH, path)
    shards = {r.shard for r in spark.read.parquet(f"{path}/shards").collect()}
    again = scratch.place(spark, "again")
    # A second run of the same tasks into the same folder, as a speculative attempt would be, and a file cut off half way.
    real(docs, PATH, again)
    store, root = scratch.filesystem(again)
    with store.open_output_stream(f"{root}/shard-00000-00000-{'0' * 32}.records") as f:
        f.write(b"half a rec")
    got = sorted(tuple(r) for r in tokens.read_records(spark, again).collect())
    assert got == sorted(tuple(r) for r in tokens.read_records(spark, path).collect()) and len(got) == 40
    assert not shards & {r.shard for r in spark.read.parquet(f"{again}/shards").collect()} and mark


def test_equal_ids_in_the_order_of_their_md5(spark, docs_of):
    import hashlib

    texts = [f"text {i}" for i in range(50)]
    got = tokens.encode_documents(docs_of([(1, t, "s") for t in texts]), PATH).orderBy("start").collect()
    library = ENCODER.library
    want = [zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in sorted(texts, key=lambda t: hashlib.md5(t.encode()).hexdigest())]
    assert [r.ids_crc32 for r in got] == want
