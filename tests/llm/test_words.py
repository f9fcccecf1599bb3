"""Word hashes against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té\x1c", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_words_and_grams(texts, limit):
    seen: dict = {}
    rows = 0
    for low, words in W.chunks(pa.array(texts, pa.string()), W.white_space(), limit * 10):
        rows += len(words.first)
        ((pieces, whole),) = words.grams(3)
        for r in range(len(words.first)):
            want = (texts[low + r] or "").encode().split()
            i, j = words.first[r], words.last[r]
            got = [words.data[a:b].tobytes() for a, b in zip(words.start[i:j], words.end[i:j])]
            assert got == want
            for w, h in zip(want, words.hash[i:j].tolist()):
                assert seen.setdefault(w, h) == h
            grams = [tuple(want[k : k + 3]) for k in range(len(want) - 2)]
            at = [k for k in range(i, j) if k < len(whole) and whole[k]]
            assert len(at) == len(grams)
            for g, k in zip(grams, at):
                assert seen.setdefault(g, int(pieces[k])) == int(pieces[k])
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 35])
def test_sliding_min(n):
    values = np.random.default_rng(n).integers(0, 1000, 200).astype(np.uint64)
    assert W.sliding_min(values, n).tolist() == [values[i : i + n].min() for i in range(200 - n + 1)]


def thue_morse(n, a="a", b="b"):
    return "".join((b if bin(i).count("1") & 1 else a) for i in range(n))


@pytest.mark.parametrize("n", [8, 64, 72, 1024, 4096])
def test_rearranged_letters_and_blocks_differ(n):
    """Words that agree under every polynomial hash modulo 2**64."""
    blocks = ("abcdefgh", "ijklmnop")
    texts = [thue_morse(n), thue_morse(n, "b", "a"), thue_morse(n, *blocks), thue_morse(n, *blocks[::-1]), "ab" * n, "ba" * n]
    ((_, words),) = W.chunks(pa.array(texts), W.white_space(), 1 << 24)
    assert len(set(words.hash.tolist())) == len(texts)
    # The same for sequences of words.
    texts = [" ".join(t[:n]) for t in texts]
    ((_, words),) = W.chunks(pa.array(texts), W.white_space(), 1 << 24)
    whole = words.grams(n)[0][0][words.first]
    assert len(set(whole.tolist())) == len({tuple(t) for t in texts})


def test_zero_bytes_count():
    ((_, words),) = W.chunks(pa.array(["a", "a\x00", "a\x00\x00", "\x00a", "aaaaaaaa", "aaaaaaaa\x00"]), W.white_space())
    assert len(set(words.hash.tolist())) == 6


def test_pieces_of_short_texts():
    texts = ["", "a", "a b", "b a", "a b c d e", "a b c d e f", "x a b c d e"]
    ((_, words),) = W.chunks(pa.array(texts), W.white_space())
    row, piece = words.pieces(5)
    per = [piece[row == i].tolist() for i in range(len(texts))]
    assert [len(p) for p in per] == [0, 1, 1, 1, 1, 2, 2]
    assert per[4][0] == per[5][0] == per[6][1] and len({*per[1], *per[2], *per[3], *per[4]}) == 4
