"""Benchmark passages in documents by a prefix-filtered set join.

An item's windows are its runs of ten words (the whole item if it is shorter).
A document can hold a window only if it holds all its words, the rarest one
included. So words are ordered by the number of documents that hold them, and
the rarest word of each window, its necessary prefix, is the join key: document
words that are some window's prefix are looked up, the window's place around the
word must fit into the document (positional and length bounds), its hash must be
one of the windows', and the words themselves are compared at the end.

The benchmark side is cut into shards of a bounded number of windows; each is
sent to the executors as one bounded object, and one pass over the documents
marks the hits of all shards, so a document is decided where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotide.llm.arrow import ids_and_texts
from heliotide.llm.words import NOT_LOWER_ALNUM, Words, slices, span_hashes, split

WINDOW = 10
#: Windows of one broadcast shard: about 200 bytes each.
SHARD_WINDOWS = 250_000
_BASE = 0xD1342543DE82EF95


def _words(data: np.ndarray, texts: np.ndarray) -> Words:
    return split(data, texts, NOT_LOWER_ALNUM, lower=True)


def _text(words: Words, a: int, b: int) -> bytes:
    return b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[a:b], words.ends[a:b]))


@dataclass(frozen=True)
class Windows:
    """Distinct windows by hash: number of words, their text, the ids of the items that hold them, and their words' hashes."""

    hashes: np.ndarray
    lengths: np.ndarray
    texts: list[bytes]
    items: list[tuple]
    words: list[np.ndarray]

    def vocabulary(self) -> np.ndarray:
        return np.unique(np.concatenate(self.words)) if self.words else np.empty(0, np.uint64)


def windows_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> Windows:
    """Windows of (item id, text) pairs; a text without words has none."""
    found: dict[bytes, list] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)
        words = _words(raw, np.array([0, len(raw)]))
        n = len(words.starts)
        size = min(window, n)
        for a in range(n - size + 1 if n else 0):
            key = _text(words, a, a + size)
            entry = found.setdefault(key, [size, set(), words.hashes[a : a + size]])
            entry[1].add(item)
    texts = list(found)
    hashes = np.array([span_hashes(found[t][2], np.array([0]), np.array([found[t][0]]), _BASE)[0] for t in texts], dtype=np.uint64)
    order = np.argsort(hashes, kind="stable").tolist()
    return Windows(
        hashes[order], np.array([found[texts[i]][0] for i in order], dtype=np.int64), [texts[i] for i in order],
        [tuple(found[texts[i]][1]) for i in order], [found[texts[i]][2] for i in order],
    )


@dataclass(frozen=True)
class Index:
    """Windows with their prefixes: for each (length, place in the window) the words that are a prefix there."""

    windows: Windows
    prefixes: dict[tuple[int, int], np.ndarray]


def index_of(windows: Windows, documents_with: dict[int, int]) -> Index:
    """Order words by the documents that hold them (then by hash); a window's prefix is its first word in that order."""
    prefixes: dict[tuple[int, int], set[int]] = {}
    for length, words in zip(windows.lengths.tolist(), windows.words):
        order = [(documents_with.get(int(w), 0), int(w)) for w in words]
        place = min(range(length), key=lambda i: order[i])
        prefixes.setdefault((length, place), set()).add(int(words[place]))
    return Index(windows, {k: np.array(sorted(v), dtype=np.uint64) for k, v in prefixes.items()})


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among ``known`` (sorted); a table of low bits sends most of them away."""
    low = np.zeros(1 << 16, dtype=bool)
    low[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = low[(values & np.uint64(0xFFFF)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
    out[maybe] = known[place] == values[maybe]
    return out


def _run_hashes(hashes: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    run = hashes[start[:, None] + np.arange(length)].ravel()
    at = np.arange(len(start) + 1) * length
    return span_hashes(run, at[:-1], at[1:], _BASE)


def occurrences(words: Words, index: Index) -> Iterator[tuple[int, int]]:
    """(first word, number of the window) of every occurrence in the texts of ``words``."""
    windows = index.windows
    if not len(words.starts) or not index.prefixes:
        return
    everything = np.unique(np.concatenate(list(index.prefixes.values())))
    candidates = np.flatnonzero(_member(words.hashes, everything))
    if not len(candidates):
        return
    of = np.searchsorted(words.first, candidates, side="right") - 1
    low, high = words.first[of], words.first[of + 1]
    for (length, place), prefix in index.prefixes.items():
        start = candidates - place
        fits = (start >= low) & (start + length <= high)
        fits[fits] = _member(words.hashes[candidates[fits]], prefix)
        start = start[fits]
        if not len(start):
            continue
        flat = np.concatenate([_run_hashes(words.hashes, part, length) for part in np.array_split(start, len(start) // 20_000 + 1)])
        spot = np.searchsorted(windows.hashes, flat)
        for a, h, w in zip(start.tolist(), flat, spot.tolist()):
            while w < len(windows.hashes) and windows.hashes[w] == h:
                if windows.lengths[w] == length and windows.texts[w] == _text(words, a, a + length):
                    yield a, w
                w += 1


def _documents_with(docs: DataFrame, shard: Broadcast) -> dict[int, int]:
    """In how many documents each word of the shard occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shard.value
        count = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for _, _, data, texts in slices(batch.column("text")):
                words = _words(data, texts)
                inside = np.flatnonzero(_member(words.hashes, known)) if len(known) else np.empty(0, np.int64)
                of = np.searchsorted(words.first, inside, side="right") - 1
                place = np.searchsorted(known, words.hashes[inside])
                count += np.bincount(np.unique(of * len(known) + place) % max(1, len(known)), minlength=len(known))
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(known[seen].view(np.int64)), pa.array(count[seen])], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in rows}


def shards(items: DataFrame, window: int = WINDOW, size: int = SHARD_WINDOWS) -> Iterator[Windows]:
    """The windows of all items (``item_id, text``), ``size`` of them or one item at a time."""
    part, n = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        part.append((row["item_id"], row["text"]))
        n += len(row["text"] or "") // 2 + 1
        if n >= size:
            yield windows_of(part, window)
            part, n = [], 0
    if part:
        yield windows_of(part, window)


def send(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_windows: int = SHARD_WINDOWS) -> list[Broadcast]:
    """The indexes of all shards of ``items``, with words ordered by the documents that hold them."""
    sc = docs.sparkSession.sparkContext
    sent = []
    for windows in shards(items, window, shard_windows):
        words = sc.broadcast(windows.vocabulary())
        sent.append(sc.broadcast(index_of(windows, _documents_with(docs, words))))
    return sent


def _marked(data: np.ndarray, texts: np.ndarray, sent: list[Broadcast]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Per text the number of words, of hit words, and the ids of the items found, as strings."""
    words = _words(data, texts)
    edges = np.zeros(len(words.starts) + 1, dtype=np.int64)
    found: list[set[str]] = [set() for _ in range(len(texts) - 1)]
    for shard in sent:
        index = shard.value
        pairs = list(occurrences(words, index))
        for (a, w), t in zip(pairs, np.searchsorted(words.first, [a for a, _ in pairs], side="right") - 1):
            edges[a] += 1
            edges[a + index.windows.lengths[w]] -= 1
            found[t].update(str(i) for i in index.windows.items[w] if i is not None)
    total = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    return np.diff(words.first).astype(np.int64), total[words.first[1:]] - total[words.first[:-1]], found


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` (item ids as sorted strings) for each row of ``docs``.

    Null texts and texts without words are never hit, and such items hit
    nothing. An item with a null id hits words but is not listed; repeated items
    count once. An empty benchmark hits nothing; an empty ``docs`` gives no rows.
    """
    docs = ids_and_texts(docs)
    sent = send(docs, items, window, shard_windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, last, data, texts in slices(batch.column("text")):
                n_words, n_hit, found = _marked(data, texts, sent)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, last - row), pa.array(n_words), pa.array(n_hit, pa.int64()),
                        pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "n_words", "n_hit", "items"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_hit bigint, items array<string>")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns, in one pass without a shuffle."""
    sent = send(ids_and_texts(docs), items, window, shard_windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_marked(data, texts, sent)[1] == 0 for _, _, data, texts in slices(batch.column("text"))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``."""
    return hits(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
