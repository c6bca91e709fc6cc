"""How far the sources of each language are apart in their words, from exact sparse document vectors.

Each text becomes a sparse vector (term, count) inside the task that reads it;
vectors are summed per (lang, source) like a grouped summary, first in the task,
then over all tasks. A term belongs to the vocabulary of its language when at
least ``min_docs`` documents hold it; there is no limit on the vocabulary's size,
so it is a table, never an object on the driver. Pairs of sources are evaluated
in blocks of terms, over the terms that occur only: all terms a source lacks
share one probability, so they enter by a histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliotide.llm.settle import settled
from heliotide.llm.words import slices, split

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Bytes other than letters and those of characters beyond ASCII.
NOT_LETTER = (*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))
SLICE_BYTES = 1 << 21
FLUSH_ENTRIES = 3_000_000
#: Entries (sources x terms) of one block of the pair evaluation.
BLOCK_CELLS = 500_000

_SUMS = "lang string, source string, term string, n bigint, docs bigint"


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, the place of one row of each, and the sums of the values per key."""
    order = np.argsort(keys, kind="stable")
    run = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.empty(0, np.int64)
    sums = [np.add.reduceat(v[order], edge) if len(edge) else v[:0] for v in values]
    return run[edge], order[edge], sums


def document_vectors(data: np.ndarray, texts: np.ndarray):
    """Sparse vectors of the texts in ``data``: (text, term, count) rows and the strings and hashes of the terms."""
    w = split(data, texts, NOT_LETTER, lower=True)
    hashes, place, code = np.unique(w.hashes, return_index=True, return_inverse=True)
    width = max(1, len(hashes))
    entries, counts = np.unique(w.text_of() * width + code, return_counts=True)
    sizes = w.ends[place] - w.starts[place]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    inside = np.repeat(w.starts[place] - offsets[:-1], sizes) + np.arange(offsets[-1])
    strings = pa.StringArray.from_buffers(len(place), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(w.data[inside])))
    return entries // width, entries % width, counts, strings, hashes


class _Sums:
    """Group sums of document vectors within a task, given out when there are many."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.entries = self.terms = 0
        self.marked: set[int] = set()

    def add(self, group_of_text: np.ndarray, vectors) -> None:
        text, term, counts, strings, hashes = vectors
        width = max(1, len(strings))
        key, _, (n, docs) = _summed(group_of_text[text] * width + term, counts, np.ones(len(counts), np.int64))
        self.parts.append((key // width, hashes[key % width], self.terms + key % width, n, docs, strings))
        self.terms += len(strings)
        self.entries += len(key)
        self.marked.update(group_of_text.tolist())

    def rows(self) -> pa.RecordBatch:
        group, hashes, term, n, docs = (np.concatenate([p[k] for p in self.parts] or [np.empty(0, np.int64)]) for k in range(5))
        strings = pa.concat_arrays([p[5] for p in self.parts]) if self.parts else pa.array([], pa.string())
        if len(self.parts) > 1:
            # Terms of several slices are numbered alike, then entries of one group and term are added up.
            _, common = np.unique(hashes, return_inverse=True)
            _, place, (n, docs) = _summed(common * len(self.groups) + group, n, docs)
            group, term = group[place], term[place]
        names = list(self.groups)
        marks = sorted(self.marked)
        every = np.concatenate([group, np.array(marks, dtype=np.int64)]).astype(np.int64)
        zero = np.zeros(len(marks), np.int64)
        out = [
            pa.array([k[0] for k in names], pa.string()).take(pa.array(every)),
            pa.array([k[1] for k in names], pa.string()).take(pa.array(every)),
            pa.concat_arrays([strings.take(pa.array(term)), pa.nulls(len(marks), pa.string())]),
            pa.array(np.concatenate([n, zero]).astype(np.int64)),
            pa.array(np.concatenate([docs, zero]).astype(np.int64)),
        ]
        self.clear()
        return pa.RecordBatch.from_arrays(out, names=["lang", "source", "term", "n", "docs"])


def _group_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for batch in batches:
        keys = zip(pc.fill_null(batch.column("lang"), "").to_pylist(), pc.fill_null(batch.column("source"), "").to_pylist())
        codes = np.array([sums.groups.setdefault(k, len(sums.groups)) for k in keys], dtype=np.int64)
        for row, last, data, texts in slices(batch.column("text"), SLICE_BYTES):
            sums.add(codes[row:last], document_vectors(data, texts))
            if sums.entries > FLUSH_ENTRIES:
                yield sums.rows()
    if sums.parts:
        yield sums.rows()


def term_sums(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, total`` of the kept terms, and one row with a null term per occurring (lang, source).

    ``n`` counts the term in the source, ``total`` in the whole language. Null
    text, lang and source are empty. One shuffle: a term's rows of all sources
    meet in one task, where they have been added up per task before.
    """
    text = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")]
    met = docs.select(*text).mapInArrow(_group_sums, _SUMS).repartition("lang", "term")
    whole = Window.partitionBy("lang", "term")
    return (
        met.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .select("lang", "source", "term", "n", F.sum("n").over(whole).alias("total"), F.sum("docs").over(whole).alias("in_docs"))
        .where((F.col("in_docs") >= min_docs) | F.col("term").isNull())
        .drop("in_docs")
    )


def probability(count: Column, known: Column, vocabulary: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / (known + vocabulary)), in whole numbers beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(
        known + vocabulary > 0,
        1 + F.floor(_div(F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), wide(known) + wide(vocabulary))),
    )


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _pairs_of_block(part: pd.DataFrame) -> pd.DataFrame:
    """Summed distances of all ordered pairs of sources over the terms of one block."""
    marks = part[part["term"].isna()]
    sources, absent = marks["source"].to_numpy(), marks["p"].to_numpy(np.int64)
    rows = part[part["term"].notna()]
    at = pd.Series(np.arange(len(sources)), index=sources)[rows["source"]].to_numpy()
    term, known = pd.factorize(rows["term"])
    p = rows["p"].to_numpy(np.int64)
    table = np.repeat(absent[:, None], len(known), axis=1)
    table[at, term] = p
    total = np.zeros((len(sources), len(sources)), np.int64)
    for q in range(len(sources)):
        values, times = np.unique(table[q], return_counts=True)
        total[:, q] = (_distance(absent[:, None], values[None, :]) * times).sum(axis=1)
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(len(sources) + 1))
    for s in range(len(sources)):
        own = order[first[s] : first[s + 1]]
        for cut in range(0, len(own), 1 << 16):
            some = own[cut : cut + (1 << 16)]
            others = table[:, term[some]]
            total[s] += (_distance(p[some][None, :], others) - _distance(absent[s], others)).sum(axis=1)
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    return pd.DataFrame({"lang": part["lang"].iloc[0], "source": sources[a], "item": sources[b], "value": total[a, b]})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to each other source, and the terms a source has more of.

    Part ``pair`` has every other source of the language with the summed
    distance over its whole vocabulary (0 where that is empty), part ``term`` the
    ``top`` terms by distance from the language. Larger values first, then items
    in byte order. Null lang, source and text count as empty; empty texts and
    texts without terms still make their group known; repeated rows count as
    often as they occur; very long texts are read whole; an empty table gives
    no rows. Only lang, source and text are read, so other columns do not matter.
    """
    kept = settled(term_sums(docs, min_docs))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("known"))
    langs = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(
        F.count("term").alias("vocabulary"), F.sum("total").alias("lang_known")
    )
    # One row per source of a language; the block count bounds what one task holds.
    blocks = F.greatest(F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) * F.col("vocabulary") / BLOCK_CELLS), F.lit(1)).cast("int")
    groups = settled(
        groups.join(langs, "lang").withColumn("blocks", blocks)
        .withColumn("absent", probability(F.lit(0), F.col("known"), F.col("vocabulary")))
    )
    seen = kept.where("term IS NOT NULL").join(groups, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("known"), F.col("vocabulary")))

    cells = seen.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p")
    marks = groups.where("vocabulary > 0").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.col("absent").alias("p")
    )
    met = cells.union(marks).groupBy("lang", "block").applyInPandas(_pairs_of_block, "lang string, source string, item string, value bigint")
    nothing = groups.where("vocabulary = 0").select("lang", "source")
    bare = nothing.join(nothing.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("bigint").alias("value"))
    pairs = met.union(bare).groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("bigint").alias("value"))

    more = seen.withColumn("q", probability(F.col("total"), F.col("lang_known"), F.col("vocabulary"))).where("p > q")
    terms = more.select("lang", "source", F.col("term").alias("item"), _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).cast("int").alias("rank"))
    return ranked(pairs, "pair").union(ranked(terms, "term").where(F.col("rank") <= top))
