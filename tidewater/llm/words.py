"""Whole batches of text as numpy arrays of word hashes.

A word is a run of bytes that are not breaks. Its hash takes eight bytes a round,
scrambled with what came before, so that no rearrangement of letters or of whole
blocks gives the same hash; words beyond 64 bytes are digested by the library.
No Python loop sees a shorter word. Null texts count as empty. Texts are cut into
chunks by bytes, never inside a text, so that memory follows the longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
CHUNK_BYTES = 1 << 19
#: Longer words are digested one by one.
ROUND, ROUNDS = 8, 8
#: The lowest k bytes of a number, for k from 0 to 8.
LOWEST = np.array([(1 << 8 * k) - 1 for k in range(ROUND + 1)], U)


def white_space() -> np.ndarray:
    """A table of 256 flags: bytes 0x20 and 0x09-0x0D end a word."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def not_alphanumeric() -> np.ndarray:
    """A table of 256 flags: ASCII bytes other than letters and digits end a word."""
    return np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    return mix(mix(a, 3) ^ b, 4)


def eight(data: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from it on as one number; behind the end come zeros."""
    padded = np.zeros(len(data) + ROUND, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes data[start:end], which depend on nothing else."""
    size = end - start
    out = mix(size.astype(U), 1)
    blocks = eight(data)
    live = None
    for k in range(ROUNDS):
        if live is None:
            out = mix(out ^ (blocks[start] & LOWEST[np.minimum(size, ROUND)]), 2)
        else:
            out[live] = mix(out[live] ^ (blocks[start[live] + ROUND * k] & LOWEST[np.minimum(size[live] - ROUND * k, ROUND)]), 2)
        live = np.flatnonzero(size > ROUND * (k + 1)) if live is None else live[size[live] > ROUND * (k + 1)]
        if not len(live):
            return out
    for i in live.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def grams(hashes: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size, ascending, the hash of that many neighbours from each place on that has them: pairs of pairs, by doubling."""
    have, own, out = 1, hashes, []
    for n in sizes:
        while have * 2 <= n:
            own = paired(own[:-have], own[have:]) if len(own) > have else own[:0]
            have *= 2
        rest = n - have
        out.append(own if not rest else paired(own[:-rest], own[rest:]) if len(own) > rest else own[:0])
    return out


class Words:
    """The words of some texts: hash, first and last byte, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~breaks[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[offsets] = False
        after = np.zeros(len(data) + 1, bool)
        after[: len(data)] = inside
        after[offsets] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets[:-1])
        self.last = np.searchsorted(self.start, offsets[1:])
        self.hash = hashed(data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.hash)

    @property
    def count(self) -> np.ndarray:
        return self.last - self.first

    def row(self) -> np.ndarray:
        """For each word the text it is in."""
        return np.repeat(np.arange(len(self.first)), self.count)

    def grams(self, *sizes: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size the hash of that many words from each word on, and whether they lie in one text."""
        last = np.repeat(self.last, self.count)
        return [(x, np.arange(len(x)) + n <= last[: len(x)]) for n, x in zip(sizes, grams(self.hash, *sizes), strict=True)]

    def pieces(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each run of n words; of a text with fewer, all its words are one. Texts without words have none."""
        count = self.count
        many = np.where(count > 0, np.maximum(1, count - n + 1), 0)
        row = np.repeat(np.arange(len(count)), many)
        begin = np.cumsum(many) - many
        at = np.arange(len(row)) - begin[row] + self.first[row]
        out = np.zeros(len(row), U)
        whole = (count >= n)[row]
        out[whole] = grams(self.hash, n)[0][at[whole]]
        few = np.flatnonzero((count > 0) & (count < n))
        key = mix(count[few].astype(U), 6)
        for k in range(n - 1):
            more = count[few] > k
            key[more] = paired(key[more], self.hash[self.first[few[more]] + k])
        out[begin[few]] = key
        return row, out


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(column, breaks: np.ndarray, limit: int = CHUNK_BYTES):
    """(first row, Words) for runs of rows of about `limit` bytes, at least one row each."""
    data, offsets = buffers(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], breaks)
        low = high


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours, by doubling."""
    have, out = 1, values
    while have * 2 <= n:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    if have < n and len(out):
        out = np.minimum(out[: -(n - have)], out[n - have :]) if len(out) > n - have else out[:0]
    return out
