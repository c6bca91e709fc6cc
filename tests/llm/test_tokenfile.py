"""Token files: exact round trips, damage, and the digests against the tokenizer."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heliotide.llm import bpe, rangecoder, tokenfile
from tests.llm import corpora


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 4), st.integers(0, 0xFFFF)), max_size=600), st.sampled_from([1, 7, 64, 100, 256]))
def test_any_ids_come_back(ids, block):
    ids = np.array(ids, dtype=np.uint32)
    assert (rangecoder.decode(rangecoder.encode(ids, block)) == ids).all()


@pytest.mark.parametrize("kind", ["one id", "two ids", "phrases", "uniform", "zipf", "rising", "greatest"])
@pytest.mark.parametrize("n", [1, 255, 4096, 30_001])
def test_long_runs_come_back(kind, n):
    rng = np.random.default_rng(n)
    phrase = rng.integers(0, 60000, 37)
    ids = {
        "one id": np.full(n, 7), "two ids": np.arange(n) % 2, "phrases": np.tile(phrase, n // 37 + 1)[:n], "uniform": rng.integers(0, 1 << 16, n),
        "zipf": np.minimum(rng.zipf(1.3, n), 50256), "rising": np.arange(n) % 65536, "greatest": np.full(n, 0xFFFF),
    }[kind].astype(np.uint32)
    code = rangecoder.encode(ids, 4096 if n > 20000 else None)
    assert (rangecoder.decode(code) == ids).all()
    if kind in ("one id", "two ids", "phrases") and n > 20000:
        assert len(code) < n / 4
    if kind == "zipf" and n > 20000:
        assert len(code) < 1.5 * n


def test_more_blocks_than_lanes(monkeypatch):
    monkeypatch.setattr(rangecoder, "LANES", 4)
    ids = np.random.default_rng(0).integers(0, 300, 1000).astype(np.uint32)
    assert (rangecoder.decode(rangecoder.encode(ids, 64)) == ids).all()


def test_each_block_starts_anew():
    """Equal blocks have equal code, whatever stands before them."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 500, 256), rng.integers(0, 500, 256)
    code = rangecoder.encode(np.concatenate([b, a, a]).astype(np.uint32), 256)
    table = np.frombuffer(code, "<u4", 9, rangecoder._HEAD.size).reshape(3, 3)
    assert (table[1] == table[2]).all() and table[0, 0] != table[1, 0]


@pytest.mark.parametrize("share", [0.001, 0.05, 0.6])
def test_surprises_among_sure_ids_come_back(share):
    """Events of the least chance leave small ranges, which the quotients must stand."""
    rng = np.random.default_rng(int(share * 1000))
    ids = np.tile(rng.integers(0, 60000, 23), 2000)
    odd = np.flatnonzero(rng.random(len(ids)) < share)
    ids[odd] = np.where(rng.random(len(odd)) < 0.5, rng.integers(0, 1 << 16, len(odd)), ids[rng.integers(0, 23, len(odd))])
    with np.errstate(all="raise"):
        assert (rangecoder.decode(rangecoder.encode(ids.astype(np.uint32), 4096)) == ids).all()


def test_code_leaves_in_words_of_three_bytes(monkeypatch):
    """Giving out words costs several passes over the lanes that do, so they are few."""
    given, shift = [], rangecoder._Encoder._shift
    monkeypatch.setattr(rangecoder._Encoder, "_shift", lambda self, lanes: (given.append(len(lanes)), shift(self, lanes))[1])
    code = rangecoder.encode(np.random.default_rng(4).integers(0, 50_000, 40_000), 4096)
    assert 3 * sum(given) <= len(code) < 2.2 * 40_000


def test_both_orders_look_into_one_cache_line(monkeypatch):
    """Two lines a lane and step were a fifth of the time of reading."""
    lines, add = [], np.add

    def spied(*args, **named):
        out = add(*args, **named)
        if named.get("out") is not None and out.shape == (2, 10) and out.dtype == np.int64:
            lines.append(out // 16)
        return out

    monkeypatch.setattr(rangecoder.np, "add", spied)
    rangecoder.encode(np.random.default_rng(5).integers(0, 50_000, 40_000), 4096)
    # Tables have sixteen numbers a line; states, which are other sums, do not count.
    at = lines[::2]
    assert len(at) > 3000 and all((x[0] == x[1]).all() for x in at)


@pytest.mark.parametrize("shape", [(1, 1), (3, 70), (64, 5), (33, 1000)])
def test_turned_arrays(shape):
    x = np.random.default_rng(1).integers(0, 1 << 16, shape).astype(np.uint16)
    turned = rangecoder._turned(x)
    assert (turned == x.T).all() and turned.flags.c_contiguous


def test_damage_is_found():
    ids = np.arange(3000, dtype=np.uint32) % 700
    segment = tokenfile.pack(pa.array([5, None], pa.int64()), np.array([1000, 2000]), ids)
    for at in range(0, len(segment), 97):
        broken = bytearray(segment)
        broken[at] ^= 0x20
        with pytest.raises((ValueError, zlib.error)):
            tokenfile.unpack(bytes(broken))
    with pytest.raises(ValueError):
        rangecoder.encode(np.array([1 << 16]))


def expected(rows, end_id=2):
    whole = bpe.tokenizer()
    known = [(i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, end_id], "<u2")) for i, t in rows]
    known.sort(key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].tobytes()), r[1].tobytes()))
    out, start = [], 0
    for i, ids in known:
        out.append((i, start, len(ids), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("part_rows,segment_ids", [(12_000, 1 << 20), (7, 400), (3, 1)])
def test_files_give_back_every_document(spark, tmp_path, part_rows, segment_ids):
    rows = corpora.corpus() + [(None, f"null {i}") for i in range(9)] + [(50, f"again {i}") for i in range(12)] + [(-4, "# \" !")]
    path = str(tmp_path / "tokens")
    tokenfile.write(corpora.frame(spark, rows).repartition(3), path, part_rows=part_rows, segment_ids=segment_ids)
    want = expected(rows)
    place = lambda r: (r["start"], r["n_tokens"])
    got = sorted(tokenfile.read(spark, path).collect(), key=place)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids"]) for r in got] == [(i, s, n, ids.tolist()) for i, s, n, ids in want]
    digests = sorted(tokenfile.digests(spark, path).collect(), key=place)
    assert [r["ids_crc32"] for r in digests] == [zlib.crc32(ids.astype("<u4").tobytes()) for *_, ids in want]


def test_report_of_an_empty_table(spark):
    got = tokenfile.report(corpora.empty(spark))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.collect() == []
