"""Collocations against counting every n-gram, and the bit filter."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from heliotide.llm import bloom, collocations
from tests.llm import corpora

SCHEMA = "doc_id bigint, text string, lang string, chunk string, own int, times bigint, h bigint, phrase string"


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def counts(rows, longest):
    f = Counter()
    for text, lang in rows:
        for ws in pieces(text):
            for k in range(1, longest + 1):
                f.update(("und" if lang is None else lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    return f


def plain(rows, least, top, longest):
    f = counts(rows, longest)
    n = Counter()
    for key, a in f.items():
        if len(key) == 2:
            n[key[0]] += a
    candidates = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    inside = lambda c, d: any(d[1 + i : i + len(c)] == c[1:] for i in range(len(d) - len(c) + 1))
    out = []
    for lang in n:
        own = {k: a for k, a in candidates.items() if k[0] == lang}
        rows_ = []
        for c, a in own.items():
            if any(len(d) > len(c) and b >= a and inside(c, d) for d, b in own.items()):
                continue
            cut = min((1000 * a * n[lang] // (f[c[: k + 1]] * f[(lang, *c[k + 1 :])]), k, f[c[: k + 1]], f[(lang, *c[k + 1 :])]) for k in range(1, len(c) - 1))
            rows_.append((-cut[0], -a, " ".join(c[1:]).encode(), cut))
        for i, (s, a, phrase, cut) in enumerate(sorted(rows_)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, cut[2], cut[3], n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    fixed = ["Los de la", "x y z w v u", "é ü\tß", "a a", "A-b c's"]
    out = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(40)):
            words.append(rng.choice(fixed) if rng.random() < 0.3 else f"w{rng.randrange(12)}")
            if rng.random() < 0.15:
                words[-1] += rng.choice([".", ", ", "!?", "\n", "\r\n", "\x0b", ":"])
        out.append((rng.choice([" ", "  ", "\t"]).join(words), rng.choice(["en", "de", None, "und", ""])))
    out += [(t, "en") for _, t in corpora.corpus()]
    out += [("a " * 3000, "en"), ("b" * 4000, "en"), (None, "de"), ("", None), (". , ;", "xx"), ("one two", "yy"), ("\x1c  z z", "en")]
    return out


@pytest.mark.parametrize("least,top,longest", [(10, 2000, 5), (3, 20, 5), (4, 2000, 2), (5, 7, 3), (100, 2000, 5)])
def test_equals_counting_every_ngram(spark, rows, least, top, longest):
    data = [(i, t, lang, "c", 1, 2, 3, "p") for i, (t, lang) in enumerate(rows)]
    got = collocations.mined(spark.createDataFrame(data, SCHEMA), least, top, longest)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, top, longest)


def test_chunks_hold_each_ngram_once(spark, rows):
    """N-grams that start in a chunk's own words, times its frequency, are all n-grams of the texts."""
    data = [(i, t, lang, "c", 1, 2, 3, "p") for i, (t, lang) in enumerate(rows)]
    entries = collocations.dictionary(spark.createDataFrame(data, SCHEMA)).collect()
    met = Counter()
    for e in entries:
        ws = e["chunk"].split(" ")
        for i in range(e["own"]):
            for k in range(1, 6):
                if i + k <= len(ws):
                    met[(e["lang"], *ws[i : i + k])] += e["times"]
    assert met == counts(rows, 5)
    assert len({(e["lang"], e["chunk"], e["own"]) for e in entries}) == len(entries)
    assert any(e["times"] > 10 for e in entries)


def test_equal_passages_are_cut_alike():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    found = []
    for before in (0, 17, 40):
        hashes = np.concatenate([rng.integers(0, 1 << 63, before).astype(np.uint64), passage])
        first = np.zeros(len(hashes), dtype=bool)
        first[0] = True
        begin = collocations.chunks(hashes, first, 4)[0] - before
        found.append(begin[begin > 0].tolist())
    assert found[0] == found[1] == found[2] and len(found[0]) > 10


def test_empty_table(spark):
    assert collocations.mined(corpora.empty(spark)).collect() == []


def test_filter_denies_no_member(spark):
    rng = np.random.default_rng(2)
    inside = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    words = bloom.filter_of(spark.createDataFrame([(int(h),) for h in inside], "h bigint"), "h", 16)
    assert len(words) == 1 << 10
    assert bloom.may_hold(words, inside.view(np.uint64)).all()
    others = rng.integers(-(1 << 63), (1 << 63) - 1, 20000)
    assert bloom.may_hold(words, others.view(np.uint64)).mean() < 0.05
    assert not bloom.may_hold(bloom.filter_of(spark.createDataFrame([], "h bigint"), "h", 16), others.view(np.uint64)).any()


class Sent:
    def __init__(self, value):
        self.value = value


def bits_of(hashes, bits=16):
    words = np.zeros(1 << (bits - 6), np.uint64)
    for slot in bloom._slots(hashes, bits):
        np.bitwise_or.at(words, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    return words


@pytest.mark.parametrize("places,flush", [(20, 3_000_000), (1, 3_000_000), (4, 5)])
def test_a_task_spells_a_phrase_once_between_flushes(monkeypatch, places, flush):
    monkeypatch.setattr(collocations._Tally, "PLACE_BITS", places)
    monkeypatch.setattr(collocations, "FLUSH_ENTRIES", flush)
    monkeypatch.setattr(collocations, "SPELL_WORDS", flush)
    rng = random.Random(3)
    entries = [(rng.choice(["en", "de"]), " ".join(f"w{rng.randrange(4)}" for _ in range(rng.randrange(1, 9))), rng.randrange(1, 5), rng.randrange(1, 4)) for _ in range(300)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*entries[a : a + 20]), (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["lang", "chunk", "own", "times"])
        for a in range(0, 300, 20)
    ]
    blocks = list(collocations._packed(iter(batches)))
    want, words = Counter(), Counter()
    for lang, chunk, own, times in entries:
        ws = chunk.split(" ")
        words[lang] += own * times
        for i in range(min(own, len(ws))):
            for k in range(1, 6):
                if i + k <= len(ws):
                    want[(lang, " ".join(ws[i : i + k]), k)] += times
    total = Counter()
    for block in blocks:
        total.update(dict(zip(block["langs"][0].as_py(), block["words"][0].as_py())))
    assert total == words
    everything = Sent(np.full(1 << 10, 0xFFFFFFFFFFFFFFFF, np.uint64))
    out = [tuple(r.values()) for b in collocations._spelled(everything, 5)(iter(blocks)) for r in b.to_pylist()]
    got = Counter()
    for lang, phrase, size, a in out:
        got[(lang, phrase, size)] += a
    assert got == want
    if flush > 300:
        assert len(out) == len(want)

    # Every level counts what may still be frequent, and at least that.
    level = lambda run: {h: n for b in run(iter(blocks)) for h, n in zip(b["h"].to_pylist(), b["n"].to_pylist())}
    if flush > 300:
        assert sorted(level(collocations._words()).values()) == sorted(n for k, n in want.items() if k[2] == 1)
        assert sorted(level(collocations._pairs(everything)).values()) == sorted(n for k, n in want.items() if k[2] == 2)
        assert sorted(level(collocations._longer(everything, 5)).values()) == sorted(n for k, n in want.items() if k[2] > 2)
    frequent = np.array([h for run in (collocations._words(), collocations._pairs(everything), collocations._longer(everything, 5)) for h, n in level(run).items() if n >= 30], np.int64)
    kept = Counter()
    for b in collocations._spelled(Sent(bits_of(frequent.view(np.uint64))), 5)(iter(blocks)):
        for r in b.to_pylist():
            kept[(r["lang"], r["phrase"], r["size"])] += r["a"]
    if flush > 300:
        assert {k: n for k, n in kept.items() if n >= 30} == {k: n for k, n in want.items() if n >= 30}


def test_a_tally_counts_every_hash():
    tally = collocations._Tally()
    hashes = np.array([0, 1, 0, 1 << 63, (1 << 63) + 1, 5, (1 << 64) - 1, 1 << 63, 0, (1 << 64) - 1], np.uint64)
    want = Counter()
    for k in range(3):
        fresh = tally.add(hashes, np.arange(10) + k)
        for h, n in zip(hashes.tolist(), range(k, 10 + k)):
            want[h] += n
    assert 3 not in fresh and 0 in fresh
    got, times = tally.rows()
    assert dict(zip(got.tolist(), times.tolist())) == want and len(got) == len(want)
    assert tally.empty and not len(tally.rows()[0])
