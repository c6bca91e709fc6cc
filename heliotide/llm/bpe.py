"""Token ids of a byte-level BPE vocabulary for whole Arrow text columns.

The published splitting pattern (contractions, runs of letters, of numbers, of
other signs, each with one leading space, and runs of white space) is applied to
all code points of a slice at once. Only the distinct pieces of a slice are
encoded, one by one; ids are then laid out by position. Texts with code points
whose class is not fixed below, or with the text of a special token, are encoded
as a whole by the tokenizer itself. Both ways give the same ids.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from heliotide.llm.words import slices, span_hashes

SLICE_BYTES = 1 << 19
VOCABULARY = "byte_bpe_50k"
_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE = range(5)


def _classes() -> np.ndarray:
    kind = np.full(0x250 + 1, _UNSURE, dtype=np.uint8)
    kind[0x21:0x7F] = _OTHER
    kind[0xA1:0xAD] = _OTHER
    kind[0xAE:0xC0] = _OTHER
    kind[0xC0:0x250] = _LETTER
    kind[[0xD7, 0xF7]] = _OTHER
    for first, last in ((0x41, 0x5B), (0x61, 0x7B)):
        kind[first:last] = _LETTER
    kind[[0xAA, 0xB5, 0xBA]] = _LETTER
    kind[0x30:0x3A] = _NUMBER
    kind[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
    kind[[0x20, *range(0x09, 0x0E)]] = _SPACE
    return kind


_KIND = _classes()
#: What may follow an apostrophe to make a piece of its own (fixed values of the published pattern).
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=2)
def tokenizer(folder: str | None = None):
    """The tokenizer of the vocabulary file; ``folder`` defaults to the installed public vocabularies."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_path(folder, f"{VOCABULARY}.json"))


def _path(folder: str | None, name: str) -> str:
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _piece_encoder(folder: str | None):
    import tiktoken

    ranks = {}
    with open(_path(folder, f"{VOCABULARY}.tiktoken"), "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


class _Known:
    """Ids of pieces met before, by hash; forgotten when there are too many.

    A table has one place per top bits of the hash, held by the piece that came
    last; pieces it does not hold are encoded.
    """

    #: Ids that are kept.
    LIMIT = 1 << 22
    PLACE_BITS = 20

    def __init__(self, folder: str | None):
        self.encode = _piece_encoder(folder)._core_bpe.encode_single_piece
        self.clear()

    def clear(self) -> None:
        self.ids = np.empty(1 << 16, np.uint32)
        self.size = 0
        self.held = np.zeros(1 << self.PLACE_BITS, np.uint64)
        # A hash that belongs elsewhere: place 0 would else seem to hold the hash 0.
        self.held[0] = np.uint64(0xFFFFFFFFFFFFFFFF)
        # Where the ids begin and, in the low half, how many there are.
        self.held_span = np.zeros(1 << self.PLACE_BITS, np.int64)

    def find(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` those of each piece ``raw[starts:stops]`` begin, and how many there are."""
        if self.size > self.LIMIT:
            self.clear()
        place = (hashes >> np.uint64(64 - self.PLACE_BITS)).view(np.int64)
        span = self.held_span.take(place)
        rest = np.flatnonzero(self.held.take(place) != hashes)
        if len(rest):
            order = np.argsort(hashes[rest])
            rest = rest[order]
            run = hashes[rest]
            edge = np.ones(len(run), dtype=bool)
            edge[1:] = run[1:] != run[:-1]
            where, code = rest[edge], np.cumsum(edge) - 1
            at, n = self._encoded(raw, starts[where], stops[where])
            new = at << 32 | n
            span[rest] = new[code]
            place, distinct = place[where], run[edge]
            self.held[place] = distinct
            # Of several hashes with one place one stays, in all three.
            stays = self.held[place] == distinct
            self.held_span[place[stays]] = new[stays]
        return span >> 32, span & 0xFFFFFFFF

    def _encoded(self, raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = list(map(self.encode, map(raw.__getitem__, map(slice, starts.tolist(), stops.tolist()))))
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        first, self.size = self.size, self.size + int(counts.sum())
        if self.size > len(self.ids):
            # Room for as many again, but not for more than are kept.
            room = max(self.size, min(2 * self.size, self.LIMIT + (1 << 16)))
            self.ids = np.concatenate([self.ids[:first], np.empty(room - first, np.uint32)])
        self.ids[first : self.size] = np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=self.size - first)
        return first + np.cumsum(counts) - counts, counts


@lru_cache(maxsize=2)
def _known(folder: str | None) -> _Known:
    return _Known(folder)


def kinds(points: np.ndarray) -> np.ndarray:
    """The class of each code point."""
    return _KIND.take(points, mode="clip")


def piece_starts(points: np.ndarray, kind: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces start among code points of fixed classes ``kind``; text t is ``points[texts[t]:texts[t+1]]``."""
    n = len(points)
    first = np.zeros(n + 1, dtype=bool)
    first[texts[:-1]] = True
    last = np.zeros(n, dtype=bool)
    last[texts[1:][texts[1:] > 0] - 1] = True
    first = first[:n]
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first
    space = kind == _SPACE
    ends_run = np.zeros(n, dtype=bool)
    ends_run[:-1] = change[1:]
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = points[:-1] == 0x20
    after_blank &= ~first
    start = (change & (space | ~after_blank)) | (space & ends_run & ~last) | first
    quotes = np.flatnonzero((points == 0x27) & start & ~last)
    if len(quotes):
        room = texts[np.searchsorted(texts, quotes, side="right")] - quotes - 1
        at = lambda k: points[np.minimum(quotes + k, n - 1)]
        open_ = np.ones(len(quotes), dtype=bool)
        for word in _CONTRACTIONS:
            hit = open_ & (room >= len(word))
            for k, ch in enumerate(word):
                hit &= at(k + 1) == ord(ch)
            open_ &= ~hit
            where = quotes[hit]
            start[where + 1] = False
            beyond = where + 1 + len(word)
            beyond = beyond[room[hit] > len(word)]
            # The rest of the letters is a piece of its own; other signs start one by the rules above.
            start[beyond[kind[beyond] == _LETTER]] = True
    return start


def _encode_slice(data: np.ndarray, texts: np.ndarray, folder: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a slice, and where each text's ids start (n + 1 offsets)."""
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    ends = np.searchsorted(heads, texts)
    kind = kinds(points)
    unsure = np.flatnonzero(kind == _UNSURE)
    plain = np.diff(np.searchsorted(unsure, ends)) == 0
    for mark in (t for t in tokenizer(folder).get_added_tokens_decoder().values() if t.content.encode() in raw):
        needle = mark.content.encode()
        for t in np.flatnonzero(plain):
            if needle in raw[texts[t] : texts[t + 1]]:
                plain[t] = False
    starts = np.flatnonzero(piece_starts(points, kind, ends)) if len(points) else np.empty(0, np.int64)
    stops = np.append(starts[1:], len(points))
    at = np.append(heads, len(data))
    hashes = span_hashes(data, at[starts], at[stops])
    known = _known(folder)
    begin, counts = known.find(hashes, raw, at[starts], at[stops])
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    source = np.repeat(begin - total[:-1], counts)
    source += np.arange(total[-1])
    ids = known.ids[source]
    offsets = total[np.searchsorted(starts, ends)]
    if plain.all():
        return ids, offsets
    parts = [
        ids[offsets[t] : offsets[t + 1]] if plain[t] else _whole(raw[texts[t] : texts[t + 1]].decode("utf-8"), folder)
        for t in range(len(plain))
    ]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _whole(text: str, folder: str | None) -> np.ndarray:
    return np.array(tokenizer(folder).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def encode(column: pa.Array | pa.ChunkedArray, folder: str | None = None):
    """For each slice of the column: (first row, last row, ids, offsets of the rows' ids). Null is empty."""
    for row, last, data, texts in slices(column, SLICE_BYTES):
        yield row, last, *_encode_slice(data, texts, folder)
