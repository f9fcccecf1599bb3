"""Token ids of a public tokenizer, written as framed binary records with an offset index.

Encoding. White space splits the work: the tokenizer drops it, so a text's ids
are those of its parts. Parts of ASCII and Latin-1 letters, digits and signs are
split further, as the tokenizer itself does, and put in lower case; each distinct
part is encoded by the library once or taken from a bounded memory, where it is
known by all its bytes. Parts with anything else in them go to the library whole. The rules hold for a
BPE vocabulary with word ends, lower case and dropped white space.

File format, for one shard of consecutive documents: records of
    length of the payload, 8 bytes; masked checksum of those 8 bytes, 4 bytes;
    payload; masked checksum of the payload, 4 bytes
all little-endian. The checksum is CRC-32 as zlib computes it, rotated right by
15 bits plus 0xA282EAD8. A payload is the doc_id (8 bytes, lowest value: null),
the width of an id in bytes (1 byte: 2 or 4), then the ids deflated as one zlib
stream. Beside each shard, a Parquet index has doc_id, offset, length and
n_tokens of each record, so that records can be read in any order.
"""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import filesystem, place, tidied, trim

END_ID = 1
#: Distinct parts remembered between batches, and encoded in one call, one by one or as one text.
REMEMBERED, CALL, JOINED = 600_000, 4096, 512
#: Bytes of text worked on at once, each of which takes some hundred bytes meanwhile.
CHUNK = 1 << 17
NO_ID = -(1 << 63)


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 digit, 3 sign, 4 anything the library shall see whole; by byte."""
    out = np.full(256, 4, np.uint8)
    for b in range(0x20, 0x7F):
        out[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3
    out[[ord("'"), ord("<")]] = 4
    out[W.white_space()] = 0
    return out


class Known:
    """Parts whose ids are known, found by hash and told apart by all their bytes: an open table of places, twice as large as needed at least.

    Arrays have room to spare and double when it is used up, so that adding costs
    what is added, not what is there.
    """

    def __init__(self, kind):
        self.bits, self.steps = 16, 0
        self.key, self.size, self.many, self.at, self.begin = (np.zeros(1 << 12, t) for t in (np.uint64, np.int32, np.int32, np.int64, np.int64))
        self.data, self.ids = np.zeros(1 << 16, np.uint8), np.zeros(1 << 14, kind)
        self.parts = self.bytes = self.used = 0
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.blocks = self._eight()

    def __len__(self) -> int:
        return self.parts

    def _eight(self) -> np.ndarray:
        """For each place the eight bytes from it on as one number: a view, as eight bytes to spare are always there."""
        return np.ndarray(len(self.data) - W.ROUND + 1, "<u8", self.data, strides=(1,))

    def _put(self, name: str, at: int, new: np.ndarray) -> None:
        own = getattr(self, name)
        if at + len(new) > len(own):
            own = np.concatenate([own[:at], np.zeros(max(len(own), at + len(new)), own.dtype)])
            setattr(self, name, own)
        own[at : at + len(new)] = new

    def _deal(self, left: np.ndarray) -> None:
        """Gives each of some parts the first free slot from its own on."""
        step = 0
        while len(left):
            slot = self._slot(self.key[left], step)
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            left = left[self.table[slot] != left]
            step += 1
        self.steps = max(self.steps, step)

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        return ((key >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, blocks: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
        """For each part its place, -1 for one that is not known."""
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        for step in range(self.steps):
            got = self.table[self._slot(key[left], step)]
            left, got = left[got >= 0], got[got >= 0]
            same = (self.key[got] == key[left]) & (self.size[got] == size[left])
            who, place, k = left[same], got[same], 0
            while len(who):  # eight bytes a round, as long as they agree
                rest = np.minimum(size[who] - k, 8)
                equal = (blocks[start[who] + k] & W.LOWEST[rest]) == (self.blocks[self.begin[place] + k] & W.LOWEST[rest])
                who, place, rest, k = who[equal], place[equal], rest[equal], k + 8
                whole = size[who] <= k
                out[who[whole]] = place[whole]
                who, place = who[~whole], place[~whole]
            left = left[out[left] < 0]
            if not len(left):
                break
        return out

    def add(self, key: np.ndarray, texts: list[bytes], ids: np.ndarray, at: np.ndarray, many: np.ndarray) -> None:
        """Parts that are not known yet, all different; the ids of each are `many` from `at` on."""
        size, low = np.array([len(t) for t in texts], np.int64), self.parts
        data = np.frombuffer(b"".join(texts) + bytes(W.ROUND), np.uint8)
        for name, new in (("key", key), ("size", size), ("many", many), ("at", at + self.used), ("begin", np.cumsum(size) - size + self.bytes)):
            self._put(name, low, new)
        self._put("data", self.bytes, data)
        self._put("ids", self.used, ids)
        self.blocks = self._eight()
        self.parts, self.bytes, self.used = low + len(key), self.bytes + len(data) - W.ROUND, self.used + len(ids)
        if 2 * self.parts > 1 << self.bits:
            while 2 * self.parts > 1 << self.bits:
                self.bits += 1
            self.table, self.steps, low = np.full(1 << self.bits, -1, np.int32), 0, 0
        self._deal(np.arange(low, self.parts, dtype=np.int32))


def _library(path: str) -> tuple:
    """(tokenizer, type of its ids, which ids end a word), read once a process: read anew for each task, it leaves ever more memory in pieces.

    Functions come to workers with their task, and so would a variable of this
    module; what outlives a task hangs on the library's own module.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_by_path", {})
    if path not in kept:
        library = tokenizers.Tokenizer.from_file(path)
        vocabulary = library.get_vocab(with_added_tokens=True)
        kind = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        kept[path] = library, kind, ends
        del vocabulary
        trim()  # reading the file takes more than what stays of it
    return kept[path]


class Encoder:
    """Ids of many texts at once."""

    def __init__(self, path: str):
        self.library, self.kind, self.ends = _library(path)
        self.classes, self.breaks = _classes(), W.white_space()
        self.known = Known(self.kind)

    def _parts(self, words: W.Words):
        """Lower-cased bytes; first byte, length, key and kind of each part; the text it is in."""
        data = words.data.copy()
        kind = self.classes[data]
        follows = np.zeros(len(data), bool)
        follows[1:] = data[:-1] == 0xC3
        follows &= (data & 0xC0) == 0x80
        letter = follows & (data != 0x97) & (data != 0xB7)
        kind[letter] = 1
        leads = np.flatnonzero(letter) - 1
        kind[leads] = 1
        upper = (data >= 0x41) & (data <= 0x5A) | letter & (data < 0x9F)
        data[upper] += 0x20
        # A word with any odd byte stays whole, as it was.
        odd = np.concatenate([[0], np.cumsum(kind == 4)])
        whole = odd[words.end] > odd[words.start]
        length = words.end - words.start
        begins = np.concatenate([[0], np.cumsum(length)])
        at = np.arange(begins[-1]) - np.repeat(begins[:-1] - words.start, length)
        odd_at = at[np.repeat(whole, length)]
        data[odd_at] = words.data[odd_at]
        kind[odd_at] = 4
        own = kind[at]
        new = np.ones(len(at), bool)
        new[1:] = (own[1:] != own[:-1]) | (own[1:] == 2)
        new[begins[:-1]] = True
        head = np.flatnonzero(new)
        start, size = at[head], np.diff(np.append(head, len(at)))
        raw = own[head] == 4
        key = W.hashed(data, start, start + size)
        return data, start, size, key, raw, np.repeat(words.row(), length)[head]

    def _encoded(self, texts: list[str], raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each part begin, how many it has)."""
        out, many = [], np.zeros(len(texts), np.int64)
        whole, plain = np.flatnonzero(raw), np.flatnonzero(~raw)
        for some in np.split(whole, range(CALL, len(whole), CALL)):
            got = [e.ids for e in self.library.encode_batch_fast([texts[i] for i in some.tolist()], add_special_tokens=False)]
            out += got
            many[some] = [len(x) for x in got]
        # Plain parts have ids of their own, which end where a word ends.
        for some in np.split(plain, range(JOINED, len(plain), JOINED)):
            got = self.library.encode(" ".join([texts[i] for i in some.tolist()]), add_special_tokens=False).ids if len(some) else []
            cut = np.flatnonzero(self.ends[got]) + 1 if got else np.zeros(0, np.int64)
            if len(cut) != len(some) or len(cut) and cut[-1] != len(got):
                raise ValueError("the vocabulary does not mark the ends of words")
            out.append(got)
            many[some] = np.diff(cut, prepend=0)
        order = np.concatenate([whole, plain])
        at = np.zeros(len(texts), np.int64)
        at[order] = np.cumsum(many[order]) - many[order]
        return np.fromiter(itertools.chain.from_iterable(out), self.kind), at, many

    def __call__(self, column):
        """(first row, ids of the rows one after another, how many each row has), chunk by chunk."""
        for low, words in W.chunks(column, self.breaks, CHUNK):
            n = len(words.first)
            if not len(words):
                yield low, np.zeros(0, self.kind), np.zeros(n, np.int64)
                continue
            data, start, size, key, raw, row = self._parts(words)
            if len(self.known) > REMEMBERED or self.known.bytes > REMEMBERED * 16:
                self.known = Known(self.kind)
            blocks = W.eight(data)
            place = self.known.find(blocks, start, size, key)
            fresh = np.flatnonzero(place < 0)
            if len(fresh):
                blob = data.tobytes()
                # A part of odd characters and one of plain ones never have the same bytes, so bytes say what a part is.
                first: dict = {}
                for i in fresh.tolist():
                    first.setdefault(blob[start[i] : start[i] + size[i]], i)
                at = np.fromiter(first.values(), np.int64, len(first))
                self.known.add(key[at], list(first), *self._encoded([x.decode() for x in first], raw[at]))
                place[fresh] = self.known.find(blocks, start[fresh], size[fresh], key[fresh])
            many = self.known.many[place]
            begin = np.cumsum(many) - many
            take = np.repeat(self.known.at[place] - begin, many) + np.arange(int(many.sum()))
            yield low, self.known.ids[take], np.bincount(row, many, n).astype(np.int64)


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    payload = (NO_ID if doc_id is None else doc_id).to_bytes(8, "little", signed=True) + bytes([ids.dtype.itemsize]) + zlib.compress(ids.astype(ids.dtype.newbyteorder("<")).tobytes(), 1)
    size = len(payload).to_bytes(8, "little")
    return size + masked(size).to_bytes(4, "little") + payload + masked(payload).to_bytes(4, "little")


def payload_size(head: bytes) -> int:
    """The length that the first 12 bytes of a record give; ValueError if their checksum is wrong, so that no damaged length is read by."""
    if len(head) != 12 or masked(head[:8]) != int.from_bytes(head[8:], "little"):
        raise ValueError("the length of a record is damaged")
    return int.from_bytes(head[:8], "little")


def unframe(record: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of one record; ValueError if a length or checksum is wrong."""
    size = payload_size(record[:12])
    payload = record[12 : 12 + size]
    if len(record) != size + 16 or masked(payload) != int.from_bytes(record[12 + size :], "little"):
        raise ValueError("a record is damaged")
    doc_id = int.from_bytes(payload[:8], "little", signed=True)
    return (None if doc_id == NO_ID else doc_id), np.frombuffer(zlib.decompress(payload[9:]), f"<u{payload[8]}")


#: Bytes of a shard, about; a longer single record makes a longer shard.
SHARD_BYTES = 32 << 20
#: Bytes of text that one task sorts and writes, about, where the session's number of shuffle partitions is too low for that.
PART_BYTES = 1 << 30
#: Tasks that read records, at most, or as many as wrote them.
READERS = 4096


def write_records(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes shards and their indexes under `path`, documents by ascending doc_id (null first), those of one doc_id by the md5 of their text.

    Returns one row a shard: shard (name), part, piece (their order), records, tokens.
    Names are an attempt's own and never written twice: of a task that ran more than
    once, the listing that Spark commits says which files count; others are no part of
    the result. The listing is written by the tasks that wrote the shards.
    """

    def run(batches):
        import uuid

        import pyarrow.parquet as pq
        from pyspark import TaskContext

        encode = Encoder(tokenizer)
        store, root = filesystem(path)
        store.create_dir(root)
        part, piece = TaskContext.get().partitionId(), 0
        out, name, index, at = None, None, [], 0

        def close():
            out.close()
            pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in index], pa.int64()), "offset": [x[1] for x in index], "length": [x[2] for x in index], "n_tokens": [x[3] for x in index]}), f"{root}/{name}.index.parquet", filesystem=store)
            return pa.RecordBatch.from_pydict({"shard": [name], "part": pa.array([part], pa.int32()), "piece": pa.array([piece], pa.int32()), "records": [len(index)], "tokens": [sum(x[3] for x in index)]})

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low, ids, sizes in encode(batch.column(1)):
                end = 0
                for k, size in enumerate(sizes.tolist()):
                    own = np.append(ids[end : end + size], ids.dtype.type(end_id))
                    end += size
                    if out is None:
                        name = f"shard-{part:05d}-{piece:05d}-{uuid.uuid4().hex}"
                        out, index, at = store.open_output_stream(f"{root}/{name}.records"), [], 0
                    record = frame(doc_ids[low + k], own)
                    out.write(record)
                    index.append((doc_ids[low + k], at, len(record), len(own)))
                    at += len(record)
                    if at >= SHARD_BYTES:
                        yield close()
                        out, piece = None, piece + 1
        if out is not None:
            yield close()

    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, size // PART_BYTES + 1)
    # Equal doc_ids are cut, where they are cut, in the order in which they are sorted.
    order = [F.col("doc_id").asc_nulls_first(), F.md5("text")]
    listing = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidied(run), "shard string, part int, piece int, records long, tokens long")
    listing.write.parquet(f"{path}/shards")
    return spark.read.schema(listing.schema).parquet(f"{path}/shards")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record of the files under `path`; every checksum is tested."""
    shards = spark.read.parquet(f"{path}/shards")
    # One row a task that wrote goes through the driver, not one a shard.
    sums = sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("tokens"), F.count("*")).collect())
    bases = list(itertools.accumulate([tokens for _, tokens, _ in sums], initial=0))
    before = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = spark.createDataFrame([(part, low) for (part, _, _), low in zip(sums, bases, strict=False)], "part int, base long")
    starts = shards.join(base, "part").select("shard", (F.col("base") + F.coalesce(F.sum("tokens").over(before), F.lit(0))).alias("start"))

    def run(batches):
        store, root = filesystem(path)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list = []
                with store.open_input_stream(f"{root}/{name}.records") as f:
                    while head := f.read(12):
                        doc_id, ids = unframe(head + f.read(payload_size(head) + 4))
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) == 4096:
                            yield _rows(out)
                            out = []
                if out:
                    yield _rows(out)

    many = max(1, min(sum(n for _, _, n in sums), max(READERS, len(sums))))
    return starts.repartition(many, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(path: str, shard: str, places: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one shard in the order asked for, by the index: shuffled reads."""
    import pyarrow.parquet as pq

    store, root = filesystem(path)
    index = pq.read_table(f"{root}/{shard}.index.parquet", filesystem=store)
    offset, length = index.column("offset").to_pylist(), index.column("length").to_pylist()
    with store.open_input_file(f"{root}/{shard}.records") as f:
        return [unframe(f.read_at(length[i], offset[i])) for i in places]


def _rows(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def encode_documents(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the records of docs and returns what reading the files gives, by document.

    A null text is empty and still ends with the end id. Rows without doc_id come
    first, repeated rows each have a record, in the order of their texts' md5. Extra
    columns are ignored; an empty table gives no files and no rows.
    """
    path = path or place(docs.sparkSession, "records")
    write_records(docs, tokenizer, path)
    return read_records(docs.sparkSession, path)
