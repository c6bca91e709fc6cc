"""Substring deduplication of word passages with suffix automata.

The reference is the corpus itself, so its shards are the passages that meet
around one shared anchor (see ``repeats``): each shard is turned into a suffix
automaton of word hashes, in the order of document ids. Every passage is first
streamed through the automaton of those with smaller ids; its matching
statistics (the longest match ending at each word) tell which windows occur
there, and only then is it added. A shard is sent to the one task where its
passages meet: broadcasting each shard to all executors would stream the whole
corpus once per shard, whose number grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heliotide.llm.repeats import WINDOW, covered, spans_of, words_as_units
from heliotide.llm.words import slices, split


class SuffixAutomaton:
    """Suffix automaton of several sequences; matches never run across two of them."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, onto: int, symbol: int) -> int:
        """A copy of ``onto`` for the strings that end with ``state`` and ``symbol``."""
        copy = self._state(self.length[state] + 1, self.link[onto], dict(self.next[onto]))
        self.link[onto] = copy
        while state != -1 and self.next[state].get(symbol) == onto:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, symbol)
        new = self._state(self.length[last] + 1, 0, {})
        state = last
        while state != -1 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state != -1:
            onto = self.next[state][symbol]
            self.link[new] = onto if self.length[onto] == self.length[state] + 1 else self._split(state, onto, symbol)
        return new

    def matching_statistics(self, sequence: list[int]) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        out, state, matched = [], 0, 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                matched += 1
            out.append(matched)
        return out


def matched_windows(contents: list[bytes], ids: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """Per passage, whether each window of words also occurs in a passage with a smaller id."""
    sequences = []
    for content in contents:
        data = np.frombuffer(content, dtype=np.uint8)
        sequences.append(split(data, np.array([0, len(data)])).hashes.tolist())
    found: list[np.ndarray] = [np.empty(0, bool)] * len(contents)
    automaton, waiting, previous = SuffixAutomaton(), [], None
    for i in sorted(range(len(ids)), key=ids.__getitem__):
        if ids[i] != previous:
            for sequence in waiting:
                automaton.add(sequence)
            waiting, previous = [], ids[i]
        lengths = automaton.matching_statistics(sequences[i])
        found[i] = np.array(lengths[window - 1 :]) >= window
        waiting.append(sequences[i])
    return found


def without_repeats(docs: DataFrame, hot_docs: int | None = None) -> DataFrame:
    """``doc_id, kept, n_words, n_removed`` for each row: the words left after removing repeated passages, joined by spaces.

    A word goes if a window of ``WINDOW`` words that covers it also starts in a
    document with a smaller doc_id. Null texts have no words. Rows without
    doc_id lose nothing; rows with the same doc_id do not count against each
    other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            for row, last, data, texts in slices(batch.column("text")):
                words = split(data, texts)
                kept, removed = [], []
                for t in range(last - row):
                    a, b = int(words.first[t]), int(words.first[t + 1])
                    keep = np.ones(b - a, dtype=bool)
                    for s, e in spans_of(spans[row + t].as_py()).tolist():
                        keep[s:e] = False
                    left = np.flatnonzero(keep) + a
                    kept.append(b" ".join(data[s:e].tobytes() for s, e in zip(words.starts[left].tolist(), words.ends[left].tolist())))
                    removed.append(b - a - len(left))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, last - row), pa.array([k.decode("utf-8") for k in kept], pa.string()),
                        pa.array(np.diff(words.first).astype(np.int64)), pa.array(removed, pa.int64()),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    ],
                    names=["doc_id", "kept", "n_words", "n_removed", "kept_sha256"],
                )

    return covered(docs, words_as_units, matched_windows, hot_docs).mapInArrow(
        run, "doc_id bigint, kept string, n_words bigint, n_removed bigint, kept_sha256 string"
    )
