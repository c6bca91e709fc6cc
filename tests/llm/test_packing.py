"""Packing by an exact round trip, and the pipeline against its stages done plainly."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from heliotide.llm import bpe, packing
from tests.llm.corpora import BASE, corpus, empty, frame


@pytest.mark.parametrize("seed", range(60))
def test_patterns_use_every_item_once(seed):
    rng = random.Random(seed)
    limit = rng.choice([8, 64, 1024])
    histogram = {n: rng.choice([1, 2, 5, 1000]) for n in rng.sample(range(1, limit), rng.randint(1, min(limit - 1, 40)))}
    found = packing.patterns(histogram, limit)
    count = Counter()
    for pack, n in found:
        assert n > 0 and sum(pack) <= limit
        for length in pack:
            count[length] += n
    assert count == histogram
    owned = Counter()
    for length, first, end, _, _, copies in packing.slots(found):
        assert first == owned[length] and (end - first) % copies == 0
        owned[length] = end
    assert owned == histogram


@pytest.mark.parametrize("limit", [16, 1024])
def test_round_trip(spark, limit):
    pairs = corpus()
    whole = bpe.tokenizer()
    got = packing.packed(frame(spark, pairs), limit, bucket_rows=7).collect()
    ids = {}
    for doc_id, text in pairs:
        ids.setdefault((doc_id, len(text or "")), whole.encode(text or "", add_special_tokens=False).ids + [0])
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    want = Counter()
    for doc_id, text in pairs:
        own = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for k in range(0, len(own), limit):
            part = own[k : k + limit]
            want[doc_id, k, len(part), zlib.crc32(part.tobytes()), len(own)] += 1
    assert pieces == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit


def test_packing_nothing(spark):
    assert packing.packed(empty(spark)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Stages keep the columns, drop what they decide on and leave clean documents alone."""
    rng = random.Random(5)
    text = lambda n: (" ".join(f"word{rng.randrange(500)}" for _ in range(n))).capitalize() + "."
    rows = [(i, text(80)) for i in range(120)]
    rows += [(200 + i, " ".join(["JUNK!!"] * 40)) for i in range(60)]
    rows += [(300, rows[0][1].replace(" ", "\n")), (301, rows[1][1] + " extra"), (302, text(30) + " " + rows[2][1]), (303, None), (None, text(50))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows if i is not None and i < 260], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[5][1].split()[10:30]))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, folder))
        assert docs.columns == BASE
        kept[name] = {r["doc_id"] for r in docs.collect()}
    clean = set(range(120)) - {5}
    assert not kept["quality"] & set(range(200, 260)) and clean <= kept["quality"]
    assert kept["quality"] - kept["exact"] == {300} or kept["quality"] - kept["exact"] == {0}
    assert kept["exact"] - kept["near"] == {301}
    assert kept["near"] - kept["decontamination"] == {5}
    packed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept["decontamination"]


def test_near_stage_decides_per_row(spark):
    """Five words and 80 %; a repeated doc_id loses only its copy, a copy without id goes too."""
    w = [f"w{i}" for i in range(400)]
    base, other = w[:100], " ".join(w[200:260])
    longer = " ".join(base + w[300:320])  # 96 of 116 shingles of five words, 97 of 117 of four
    rows = [(3, " ".join(base)), (7, longer), (7, other), (None, " ".join(base[1:])), (None, "alone " * 9), (8, None), (8, ""), (9, "-")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_stage(spark, docs, "")
    assert kept.columns == BASE
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in rows if t not in (longer, " ".join(base[1:])))
