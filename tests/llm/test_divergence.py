"""Divergence of sources against a plain version in whole numbers."""

import re
from collections import Counter, defaultdict

import pytest

from heliotide.llm import divergence
from tests.llm import corpora

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n bigint, p bigint, total bigint"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain(rows, min_docs, top):
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = TERM.findall(lower(text or ""))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
        sources[lang or ""].add(source or "")
    out = []
    for lang, some in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter()
        for s in some:
            whole.update({t: counts[lang, s][t] for t in kept})
        prob = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        p, q = {s: prob(counts[lang, s]) for s in some}, prob(whole)
        far = lambda a, b: (a - b) * (a - b) // b
        for s in some:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in some if o != s]
            terms = [(far(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    pick = lambda i, some: some[i % len(some)]
    out = [(t, pick(i, ["en", "de", None, ""]), pick(i // 4, ["a", "b", "Ö", None, "c"])) for i, (_, t) in enumerate(corpora.corpus())]
    out += [("Straße ÜBER straße A-b_c 12 x1y", "en", "a")] * 3
    out += [(None, "xx", "only"), ("", "xx", "other"), ("1 2 3", "xx", None), ("once", "yy", "alone")]
    return out


@pytest.mark.parametrize("min_docs,top,cells", [(3, 200, divergence.BLOCK_CELLS), (1, 5, 50), (2, 1, 400)])
def test_equals_the_plain_version(spark, rows, monkeypatch, min_docs, top, cells):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    data = [(i, t, lang, source, "t", 1, 2, 3) for i, (t, lang, source) in enumerate(rows)]
    got = rows_of(divergence.audit(spark.createDataFrame(data, SCHEMA), min_docs, top))
    assert got == plain(rows, min_docs, top)


def test_sums_do_not_depend_on_flushes_and_slices(spark, rows, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"lang": a, "source": b, "text": t} for t, a, b in rows], pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.string())]))

    def totals(limit, size):
        monkeypatch.setattr(divergence, "FLUSH_ENTRIES", limit)
        monkeypatch.setattr(divergence, "SLICE_BYTES", size)
        seen = Counter(), Counter()
        for out in divergence._group_sums(iter([batch, batch])):
            for r in out.to_pylist():
                seen[0][r["lang"], r["source"], r["term"]] += r["n"]
                seen[1][r["lang"], r["source"], r["term"]] += r["docs"]
        return seen

    assert totals(10**9, 1 << 30) == totals(50, 200) == totals(10**9, 3000)


def test_empty_table(spark):
    assert divergence.audit(corpora.empty(spark)).collect() == []


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 5_000_000_000_000_000
    got = spark.range(1).select(divergence.probability(F.lit(big), F.lit(2 * big), F.lit(7))).head()[0]
    assert got == 1 + 10**9 * (big + 1) // (2 * big + 7)
