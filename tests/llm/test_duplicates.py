"""Exact, near and substring duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heliotide.llm import automaton, components, exact, near, repeats, suffixes
from tests.llm.corpora import BASE, corpus, empty, frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def plain_exact(pairs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    order = lambda p: (-len(p[1] or ""), p[0] is None, p[0] or 0)
    groups = {}
    for p in pairs:
        groups.setdefault(norm(p[1]), []).append(p)
    out = Counter()
    for key, members in groups.items():
        best = min(members, key=order)
        for p in members:
            kept = order(p) == order(best)
            out[p[0], best[0], len(members), kept, hashlib.sha256(key.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("digest", [exact.whole, lambda sha: F.substring(sha, 1, 1)], ids=["sha256", "clashing"])
def test_exact(spark, digest):
    pairs = corpus()
    docs = frame(spark, pairs)
    assert rows_of(exact.report(docs, digest, salts=3)) == plain_exact(pairs)
    kept = exact.without_copies(docs, digest)
    assert kept.columns == docs.columns
    norm = {re.sub(r"\s", "", t or "") for _, t in pairs}
    assert Counter(re.sub(r"\s", "", r["text"] or "") for r in kept.collect()) == Counter(norm)


def test_exact_of_nothing_and_of_one_hot_text(spark):
    assert exact.report(empty(spark)).count() == 0
    docs = frame(spark, [(i, "same text" if i % 3 else f"text {i}") for i in range(300)])
    got = exact.report(docs).where("group_size > 1").select("keep_id", "group_size", "kept").groupBy("keep_id", "group_size").agg(F.sum(F.col("kept").cast("int"))).collect()
    assert [tuple(r) for r in got] == [(1, 200, 1)]


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[a : a + 4]) for a in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def plain_near(pairs):
    sets = [shingle_set(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(pairs):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(pairs, sets)))


def drifting(seed):
    """Chains of copies that differ a little from their forerunner, so links reach farther than the threshold."""
    rng = random.Random(seed)
    out, text = [], words(rng, 150)
    for i in range(40):
        if i % 10 == 0:
            text = words(rng, rng.choice([60, 150, 300]))
        text = list(text)
        text[rng.randrange(len(text))] = f"new{i}"
        out.append((i * 7 % 41, " ".join(text)))
    return out


@pytest.mark.parametrize("frequent", [near.FREQUENT, 3, -1000], ids=["single", "mixed", "pairs"])
def test_near(spark, frequent):
    pairs = corpus() + [(200 + i, t) for i, t in drifting(5)]
    assert rows_of(near.near_duplicates(frame(spark, pairs), frequent=frequent)) == plain_near(pairs)


def test_near_of_nothing(spark):
    assert near.near_duplicates(empty(spark)).count() == 0
    assert rows_of(near.near_duplicates(frame(spark, [(1, None), (2, ""), (2, " ")]))) == Counter({(1, 0, 1): 1, (2, 0, 2): 2})


@pytest.mark.parametrize("seed", range(30))
def test_similar_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    ranks = rng.choice([1, 2, 3, 255], 1 << near.COUNTER_BITS, p=[0.2, 0.1, 0.1, 0.6]).astype(np.uint8)
    x = np.unique(rng.integers(0, 2**64, rng.integers(2, 120), dtype=np.uint64))
    y = np.unique(np.concatenate([rng.permutation(x)[: max(1, int(len(x) * 0.93))], rng.integers(0, 2**64, rng.integers(0, 8), dtype=np.uint64)]))
    if near.similar(x, y) and len(y) > 1:
        differing = int(np.bitwise_count((near.parity_longs(x) ^ near.parity_longs(y)).view(np.uint64)).sum())
        assert differing * 185 <= (len(x) + len(y)) * 15
        assert near.may_link(len(x), near.parity_bits(x), len(y), near.parity_bits(y))
        assert set(near.signatures(x, ranks).tolist()) & set(near.signatures(y, ranks).tolist())


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(25)] + [(-5, 7), (7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["a"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: find(v) for v in root if find(v) != v}


def plain_repeats(pairs, units, join):
    first = {}
    for i, text in pairs:
        u = units(text or "")
        for a in range(len(u) - 49):
            if i is not None:
                first[u[a : a + 50]] = min(i, first.get(u[a : a + 50], i))
    out = Counter()
    for i, text in pairs:
        u = units(text or "")
        gone = [False] * len(u)
        for a in range(len(u) - 49):
            if i is not None and first[u[a : a + 50]] < i:
                gone[a : a + 50] = [True] * 50
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(u), sum(gone), runs, hashlib.sha256(join(x for x, g in zip(u, gone) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot_docs", [None, 2, 6])
def test_word_passages(spark, hot_docs):
    pairs = corpus()
    got = automaton.without_repeats(frame(spark, pairs), hot_docs).select("doc_id", "n_words", "n_removed", F.lit(0), "kept_sha256")
    plain = plain_repeats(pairs, lambda t: tuple(WORD.findall(t)), lambda u: " ".join(u).encode())
    assert rows_of(got) == Counter({(i, n, r, 0, s): c for (i, n, r, _, s), c in plain.items()})
    assert got.where("n_removed > 0").count() > 10


@pytest.mark.parametrize("hot_docs", [None, 2, 6])
def test_byte_strings(spark, hot_docs):
    pairs = [(i, t[:900] if t else t) for i, t in corpus(documents=40)]
    got = suffixes.without_repeats(frame(spark, pairs), hot_docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(got) == plain_repeats(pairs, lambda t: t.encode(), bytes)


def test_passages_of_nothing(spark):
    assert automaton.without_repeats(empty(spark)).count() == 0
    assert suffixes.without_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_matchers_agree_with_windows(seed):
    rng = random.Random(seed)
    alphabet = rng.choice([["a"], ["a", "b"], list("abcdefgh")])
    pieces = [[rng.choice(alphabet) for _ in range(rng.randint(8, 30))] for _ in range(5)]
    sequences = [sum((rng.choice(pieces) for _ in range(2)), []) for _ in range(8)]
    ids = [rng.randrange(6) for _ in sequences]
    size = 8
    want = [
        [any(ids[k] < ids[i] and any(t[b : b + size] == s[a : a + size] for b in range(len(t) - size + 1)) for k, t in enumerate(sequences)) for a in range(len(s) - size + 1)]
        for i, s in enumerate(sequences)
    ]
    assert [f.tolist() for f in automaton.matched_windows([" ".join(s).encode() for s in sequences], ids, size)] == want
    assert [f.tolist() for f in suffixes.repeated_windows(["".join(s).encode() for s in sequences], ids, size)] == want


def test_maximal_repeats_list_all_occurrences():
    contents = [b"xxabcdefgh1", b"yyabcdefgh2", b"zzabcdefgq3"]
    content, start, common, left = suffixes.enhanced_suffix_array(contents, 4)
    found = {
        (contents[content[a]][start[a] : start[a] + n], tuple(sorted(zip(content[a:b].tolist(), start[a:b].tolist()))))
        for n, a, b in suffixes.maximal_repeats(common.tolist(), left.tolist(), 4)
    }
    assert found == {(b"abcdefg", ((0, 2), (1, 2), (2, 2))), (b"abcdefgh", ((0, 2), (1, 2)))}


def test_each_task_sends_one_row_per_text(spark):
    docs = frame(spark, [(i, "one text") for i in range(300)] + [(i, "another") for i in range(300, 350)]).coalesce(1)
    assert sorted((r["_content"], r["_n"]) for r in exact.salted(docs, salts=8).collect()) == [("another", 50), ("onetext", 300)]


@pytest.mark.parametrize("width", [1, 2, 7, 35])
def test_least_places_are_the_first_of_each_window(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 34, 35, 36, 70, 71, 500):
        values = rng.integers(0, 6, n).astype(np.uint64)
        want = [i + int(np.argmin(values[i : i + width])) for i in range(n - width + 1)]
        assert repeats.least_places(values, width).tolist() == want
    top = np.full(40, np.uint64(0xFFFFFFFFFFFFFFFF))
    assert repeats.least_places(top, width).tolist() == list(range(40 - width + 1))


def test_grams_read_every_byte():
    data = np.random.default_rng(0).integers(0, 256, 300).astype(np.uint8)
    plain = [data[i : i + repeats.BYTE_GRAM].tobytes() for i in range(300 - repeats.BYTE_GRAM + 1)]
    doubled = repeats._grams(np.concatenate([data, data]))
    assert len(repeats._grams(data)) == len(plain) == len(set(repeats._grams(data).tolist()))
    assert (doubled[: len(plain)] == doubled[300 : 300 + len(plain)]).all()
    assert all(len(repeats._grams(data[:n])) == max(0, n - repeats.BYTE_GRAM + 1) for n in range(25))


def test_suffixes_that_stand_alone_change_nothing():
    """Windows found with and without the suffixes that share their start with no other."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        contents = [bytes(rng.integers(97, 100, rng.integers(0, 60)).astype(np.uint8)) for _ in range(6)]
        ids = rng.integers(0, 4, 6).tolist()
        got = suffixes.repeated_windows(contents, ids, 5)
        for i, c in enumerate(contents):
            want = [any(ids[j] < ids[i] and c[k : k + 5] in contents[j] for j in range(6)) for k in range(max(0, len(c) - 4))]
            assert got[i].tolist() == want


def test_a_bucket_of_anchors_takes_little_memory():
    """Two tasks of a small executor each hold a bucket of some millions; before, each anchor took 115 bytes."""
    import tracemalloc

    rng, n, per = np.random.default_rng(1), 1000, 100
    doc, place = np.repeat(np.arange(n), per), np.tile(np.arange(per), n)
    rows = []
    for part in range(4):
        anchor = rng.integers(0, 1 << 62, n * per).astype(np.uint64)
        rows.append(repeats._anchor_rows([(anchor, doc, doc + part * n, (doc + part * n) * 7919, place)], 1))
    table = pa.Table.from_batches(rows)
    tracemalloc.start()
    repeats._meet_anchors(1000)(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 85 * 4 * n * per


def test_components_of_a_group_meet_through_centres_first(spark):
    """Of 300 members in 60 components each meets at most four others, in other components, before pairs are made."""
    rows = [(sig, k, 20, k % 60, 0) for sig in (1, 2) for k in range(300)]
    mixed = spark.createDataFrame(rows, "sig bigint, class_key bigint, n bigint, root bigint, major bigint")
    got = [tuple(r) for r in near._stars_across(mixed).collect()]
    assert {a for a, _ in got} == set(range(300)) and all(a % 60 != b % 60 for a, b in got)
    assert max(Counter(a for a, _ in got).values()) <= 8 and len({b for _, b in got}) > 4
