"""A bit filter of fixed size over 64-bit hashes: what it denies is not in the set, whatever the input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 4 MB at any size of input; beyond some ten million hashes it only denies less.
BITS = 25
_WORD = 6


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return hashes & mask, (hashes >> np.uint64(64 - bits)) & mask


def filter_of(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Bits of all values of ``column`` (bigint); at most ``2**(bits - 6)`` rows reach the driver."""
    h = F.col(column)
    mask = (1 << bits) - 1
    slots = F.array(h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, 64 - bits).bitwiseAND(F.lit(mask)))
    marked = hashes.select(F.explode(slots).alias("slot")).select(
        F.shiftright("slot", _WORD).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)).cast("int")).alias("bit")
    )
    rows = marked.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - _WORD), dtype=np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint64)


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each of ``hashes`` (uint64) may be in the set."""
    bits = len(words).bit_length() - 1 + _WORD
    out = np.ones(len(hashes), dtype=bool)
    for slot in _slots(hashes, bits):
        out &= (words[(slot >> np.uint64(_WORD)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return out
