"""Repeated byte strings by the interval tree of an enhanced suffix array.

Passages that meet around a shared anchor (see ``repeats``) are sorted by their
suffixes; neighbours get the length of their common prefix. A stack scan over
these lengths visits the intervals of the common-prefix tree, and an interval is
a maximal repeat if its occurrences have different bytes to their left. Each
maximal repeat comes with all of its occurrences, so a string is covered
wherever a document with a smaller id holds it, not only next to its neighbour
in sorted order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heliotide.llm.repeats import WINDOW, bytes_as_units, covered, spans_of
from heliotide.llm.words import slices, span_hashes

_BORDER = -1
#: Passages sorted together: one array for many shards costs less than many small ones.
BATCH = 4096


def _met_again(contents: list[bytes], content: np.ndarray, start: np.ndarray, least: int) -> np.ndarray:
    """Suffixes whose first ``least`` bytes begin another suffix too (by hash, so a few more may be left in).

    No other suffix lies in an interval with a common prefix of that length.
    """
    first = np.cumsum([0, *map(len, contents)])
    at = first[content] + start
    head = span_hashes(np.frombuffer(b"".join(contents), np.uint8), at, at + least)
    order = np.argsort(head)
    run = head[order]
    same = run[1:] == run[:-1]
    again = np.zeros(len(head), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.flatnonzero(again)


def enhanced_suffix_array(contents: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(content, start, common prefix with the entry before, byte to the left or -1) of the suffixes that share their first ``least`` bytes, sorted."""
    counts = np.array([max(0, len(c) - least + 1) for c in contents], dtype=np.int64)
    content = np.repeat(np.arange(len(contents)), counts)
    start = np.arange(len(content)) - np.repeat(np.cumsum(counts) - counts, counts)
    again = _met_again(contents, content, start, least)
    content, start = content[again], start[again]
    width = -(-max(map(len, contents), default=0) // 8) * 8
    padded = np.zeros((len(contents), width * 2), dtype=np.uint8)
    for i, c in enumerate(contents):
        padded[i, : len(c)] = np.frombuffer(c, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)[content, start]
    size = np.array([len(c) for c in contents], dtype=np.int64)[content] - start
    columns = rows.view(">u8")
    order = np.lexsort((size, *[columns[:, k] for k in range(columns.shape[1] - 1, -1, -1)]))
    rows, content, start, size = rows[order], content[order], start[order], size[order]
    common = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        differ = rows[1:] != rows[:-1]
        place = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[1:] = np.minimum(place, np.minimum(size[1:], size[:-1]))
    left = np.full(len(order), _BORDER, dtype=np.int64)
    inner = start > 0
    left[inner] = padded[content[inner], start[inner] - 1]
    return content, start, common, left


def maximal_repeats(common: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first entry, end entry) of every maximal repeat of at least ``least`` symbols, by one stack scan.

    An interval keeps the byte to the left of its occurrences as long as it is
    the same for all; the border of a text differs from everything.
    """
    mixed = -2
    stack: list[list[int]] = []  # length, first entry, byte to the left

    def joined(a: int, b: int) -> int:
        return a if a == b and a != _BORDER else mixed

    for i in range(1, len(common) + 1):
        length = common[i] if i < len(common) else 0
        first, byte = i - 1, left[i - 1]
        while stack and stack[-1][0] > length:
            top = stack.pop()
            byte = joined(byte, top[2])
            first = top[1]
            if byte == mixed:
                yield top[0], first, i
        if stack and stack[-1][0] == length:
            stack[-1][2] = joined(stack[-1][2], byte)
        elif length >= least:
            stack.append([length, first, byte])


def repeated_windows(contents: list[bytes], ids: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """Per passage, whether each window of bytes also occurs in a passage with a smaller id."""
    content, start, common, left = enhanced_suffix_array(contents, window)
    found = [np.zeros(max(0, len(c) - window + 1), dtype=bool) for c in contents]
    owner = np.array(ids, dtype=np.int64)[content]
    for length, a, b in maximal_repeats(np.minimum(common, 1 << 30).tolist(), left.tolist(), window):
        least = owner[a:b].min()
        for i in (np.flatnonzero(owner[a:b] > least) + a).tolist():
            found[content[i]][start[i] : start[i] + length - window + 1] = True
    return found


def without_repeats(docs: DataFrame, hot_docs: int | None = None) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans`` for each row: the bytes left after removing repeated strings.

    A byte goes if a string of ``WINDOW`` bytes that covers it also starts in a
    document with a smaller doc_id. ``kept`` is binary, as a cut may fall inside
    a character. Null texts have no bytes. Rows without doc_id lose nothing;
    rows with the same doc_id do not count against each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            for row, last, data, texts in slices(batch.column("text")):
                kept, removed, number = [], [], []
                for t in range(last - row):
                    own, cut, at = data[texts[t] : texts[t + 1]], spans_of(spans[row + t].as_py()), 0
                    parts = []
                    for s, e in cut.tolist():
                        parts.append(own[at:s].tobytes())
                        at = e
                    kept.append(b"".join([*parts, own[at:].tobytes()]))
                    removed.append(int((cut[:, 1] - cut[:, 0]).sum()))
                    number.append(len(cut))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, last - row), pa.array(kept, pa.binary()), pa.array(np.diff(texts).astype(np.int64)),
                        pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    ],
                    names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return covered(docs, bytes_as_units, repeated_windows, hot_docs, BATCH).mapInArrow(
        run, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
