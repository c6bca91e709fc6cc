"""Words, hashes and token ids against plain versions."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heliotide.llm import bpe, words

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ é\t\n\x0b.1_中ß", max_size=12)), max_size=8))
def test_split_like_the_patterns(texts):
    for pattern, apart, fold in ((WHITE, words.WHITE, False), (WHITE, words.WHITE, True), (ALNUM, words.NOT_LOWER_ALNUM, True)):
        got = []
        for _, _, data, at in words.slices(pa.array(texts, pa.string()), 10):
            w = words.split(data, at, apart, fold)
            got += [[w.data[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
        assert got == [pattern.findall(lower(t or "") if fold else t or "") for t in texts]


def test_equal_spans_have_equal_hashes_and_others_do_not():
    values = np.array([1, 2, 3, 9, 1, 2, 3, 1, 2], dtype=np.uint64)
    h = words.span_hashes(values, np.array([0, 4, 0, 7, 0]), np.array([3, 7, 2, 9, 1]))
    assert h[0] == h[1] and h[2] == h[3] and len(set(h.tolist())) == 3
    assert len(words.shingles(values[:2], 3)) == 0


def test_sliced_arrays_keep_their_place():
    column = pa.array(["ab", "cd ef", None, "gh"]).slice(1)
    got = [(r, e, d.tobytes()) for r, e, d, _ in words.slices(column, 3)]
    assert b"".join(x[2] for x in got) == b"cd efgh" and got[-1][1] == 3


@pytest.mark.parametrize("seed", range(4))
def test_token_ids_equal_the_tokenizer(seed):
    rng = random.Random(seed)
    parts = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "A", "é", "1", "²", ".", "!", "ß", "€", "中", "<|endoftext|>", "’", "\x1c", "ª", "·", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["", None, " ", "it's we'll 'tis\n's"]
    whole = bpe.tokenizer()
    for row, last, ids, at in bpe.encode(pa.array(texts, pa.string())):
        for k in range(row, last):
            assert ids[at[k - row] : at[k - row + 1]].tolist() == whole.encode(texts[k] or "", add_special_tokens=False).ids, texts[k]


def test_pieces_met_before_are_not_sorted_again(monkeypatch):
    rng = random.Random(5)
    column = pa.array([" ".join(rng.choice(["ab", "it's", "naïve", "1234", "zyxwv"]) for _ in range(200)) for _ in range(50)])
    first = [ids.tolist() for _, _, ids, _ in bpe.encode(column)]
    sorted_, unique = [], np.unique
    monkeypatch.setattr(bpe.np, "unique", lambda x, *a, **b: (sorted_.append(len(x)), unique(x, *a, **b))[1])
    assert [ids.tolist() for _, _, ids, _ in bpe.encode(column)] == first
    assert sum(sorted_) == 0


@pytest.mark.parametrize("bits", [1, 6])
def test_pieces_that_share_a_place(monkeypatch, bits):
    rng = random.Random(bits)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(30)) for _ in range(40)]
    monkeypatch.setattr(bpe._Known, "PLACE_BITS", bits)
    known = bpe._Known(None)
    monkeypatch.setattr(bpe, "_known", lambda folder: known)
    whole = bpe.tokenizer()
    for part in (texts, texts[::-1], texts):
        for row, last, ids, at in bpe.encode(pa.array(part)):
            for k in range(row, last):
                assert ids[at[k - row] : at[k - row + 1]].tolist() == whole.encode(part[k], add_special_tokens=False).ids


def test_encoding_takes_little_room():
    """Whatever the batch, a slice of it at a time."""
    rng = random.Random(2)
    words_ = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    column = pa.array([" ".join(rng.choices(words_, k=500)) for _ in range(1500)])
    for _ in bpe.encode(column):
        pass
    tracemalloc.start()
    for _ in bpe.encode(column):
        pass
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 48e6


def test_pieces_without_a_place_are_encoded_and_forgotten_in_time(monkeypatch):
    """What stays between slices is bounded by the places and by the ids kept."""
    monkeypatch.setattr(bpe._Known, "PLACE_BITS", 3)
    monkeypatch.setattr(bpe._Known, "LIMIT", 50)
    known = bpe._Known(None)
    raw = b"one two three oneone twenty2 x"
    which = [0, 1, 2, 3, 4, 5, 0, 1, 2]
    starts, stops = np.array([0, 3, 7, 13, 20, 28])[which], np.array([3, 7, 13, 20, 28, 30])[which]
    hashes = np.array([5, 1 << 63, (1 << 63) + 1, 0, (1 << 61) + 3, 9], np.uint64)[which]
    for _ in range(30):
        begin, counts = known.find(hashes, raw, starts, stops)
        got = [known.ids[a : a + n].tolist() for a, n in zip(begin, counts)]
        assert got == [known.encode(raw[a:b]) for a, b in zip(starts, stops)]
        assert known.size <= 50 + sum(map(len, got))
    assert len(known.held) == 8


def test_many_pieces_are_remembered():
    """Made-up words are many; most of those met before need not be encoded again."""
    known = bpe._Known(None)
    anew = []
    known.encode = lambda piece: (anew.append(piece), [1, 2, 3, 4])[1]
    hashes = np.random.default_rng(0).integers(0, 1 << 64, 400_000, np.uint64)
    for _ in range(2):
        anew.clear()
        for part in np.array_split(hashes, 40):
            known.find(part, b"abcd", np.zeros(len(part), np.int64), np.full(len(part), 4))
    assert len(anew) < 0.4 * len(hashes)
