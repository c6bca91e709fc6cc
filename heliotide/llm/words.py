"""Word positions and 64-bit hashes of whole Arrow text columns, in numpy.

A column's texts lie one after another in one byte buffer, so splitting,
lower-casing and hashing work on all texts of a slice at once. Equal words have
equal hashes whatever their place; different words collide with a chance near
2**-64. Slices are bounded by bytes, so memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = 0x5851F42D4C957F2D
_SHINGLE_BASE = 0xD1342543DE82EF95

WHITE = (0x20, *range(0x09, 0x0E))
#: Neither digits, nor lower-case letters, nor bytes of characters beyond ASCII.
NOT_LOWER_ALNUM = (*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))


@dataclass
class Words:
    """Words of some texts: ``data[starts[i]:ends[i]]`` is word i; text t has words ``first[t]:first[t+1]``."""

    data: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known[0]) <= n:
        size = max(n + 1, 1 << 12)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            run = np.full(size, b, dtype=np.uint64)
            run[0] = 1
            both.append(np.cumprod(run, dtype=np.uint64))
        known = (both[0], both[1])
        if size <= 1 << 23:
            _powers[base] = known
    return known


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _WORD_BASE) -> np.ndarray:
    """Hash of ``values[starts:ends]`` for each pair; equal spans have equal hashes."""
    power, inverse = _powers_of(base, len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)


def shingles(hashes: np.ndarray, k: int, base: int = _SHINGLE_BASE) -> np.ndarray:
    """Hash of every k consecutive values; ``len(hashes) - k + 1`` of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    starts = np.arange(n)
    return span_hashes(hashes, starts, starts + k, base)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) over whole texts, cut so that a slice passes ``limit`` by one text at most.

    A null text is empty. Offsets are relative to the slice.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        last = min(last, len(column))
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def split(data: np.ndarray, texts: np.ndarray, apart: tuple[int, ...] = WHITE, lower: bool = False) -> Words:
    """Words of the texts in ``data`` (text t is ``data[texts[t]:texts[t+1]]``): longest runs without the bytes ``apart``."""
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[0x41:0x5B] += 0x20
    data = fold[data] if lower else data
    kind = np.ones(256, dtype=bool)
    kind[list(apart)] = False
    inside = kind[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    edges = texts[:-1][np.diff(texts) > 0]
    start = inside & ~before[:-1]
    start[edges] = inside[edges]
    after = np.empty(len(data), dtype=bool)
    if len(data):
        after[:-1] = start[1:] | ~inside[1:]
        after[-1] = True
        after[edges[1:] - 1] = True
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(inside & after) + 1
    first = np.searchsorted(starts, texts)
    return Words(data, texts, starts, ends, first, span_hashes(data, starts, ends))
