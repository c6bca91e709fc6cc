"""Token ids as arithmetic code, from predictions of order 0 to 2 that are mixed and learnt while coding.

Ids are cut into blocks. Every block starts from the same state and has its own
checksum, so any of them can be read alone; the blocks of a segment are coded
side by side, one numpy lane each.

Per id the contexts of the last two ids (order 2) and of the last one (order 1)
each name the id they expect and how sure they are. Each has learnt how often it
is right when that sure; a weight, learnt from which of the two did better,
mixes them into the chance of the one id, the other, or neither. In the last
case order 0 gives the id by how often it stood among the ids before, counted
anew each time the block has doubled (later every 1 024 ids); an id not among
them follows as it is. All numbers are whole, so every machine computes the same.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids are coded as 16 bits.
MOST_ID = 0xFFFF
BLOCK = 4096
SMALLEST_BLOCK = 256
LANES = 4096
_MAGIC = b"HTID"
_VERSION = 2
_HEAD = struct.Struct("<4sHHIQ")
_CRC = struct.Struct("<I")

_BITS = 15
_ONE = 1 << _BITS
_LOW, _HIGH = 16, _ONE - 64
_TABLE = 11
_SURE = 7
_RATE = 5
_WORD = 24
_SHORT = 1 << _WORD
_REST = _SHORT - 1
_SPAN = np.int32(_HIGH - _LOW)
_STEP = np.int32(512)
_HASH = np.uint32(0x9E3779B1)
_RIGHT = np.array([_LOW * 8, 6000, 12000, 18000, 22000, 25000, 27000, 29000], np.int32)
_FIRST_COUNT, _WINDOW, _RECOUNT = 64, 2048, 1024
_SHARED, _GROUP = 16, 64
_STRIP = 32


def _turned(x: np.ndarray) -> np.ndarray:
    """``x.T`` as an array of its own, made in strips: turned at one go, every number would miss the cache."""
    out = np.empty(x.shape[::-1], x.dtype)
    for k in range(0, len(x), _STRIP):
        out[:, k : k + _STRIP] = x[k : k + _STRIP].T
    return out


class _Encoder:
    """Low ends and ranges of 48 bits; a range below 24 bits gives out a word of as many."""

    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, (1 << 48) - 1, np.int64)
        self.at = np.zeros(lanes, np.int64)
        self.words = np.zeros((max(64, steps), lanes), np.uint32)
        self.most = 0
        self.room = np.empty((3, lanes), np.int64)
        self.ratio = np.empty(lanes)

    def _shift(self, lanes: np.ndarray) -> None:
        if self.most >= len(self.words):
            self.most = int(self.at.max()) + 1
            if self.most >= len(self.words):
                self.words = np.concatenate([self.words, np.zeros_like(self.words)])
        self.most += 1
        at, low = self.at[lanes], self.low[lanes]
        # Bit 48 is a carry into the word before; it is settled at the end.
        self.words.reshape(-1)[at * len(self.low) + lanes] = low >> _WORD
        self.at[lanes] = at + 1
        self.low[lanes] = (low & _REST) << _WORD

    def settle(self, lanes: np.ndarray | None = None) -> None:
        short = np.flatnonzero(self.range < _SHORT) if lanes is None else lanes[self.range[lanes] < _SHORT]
        while len(short):
            self._shift(short)
            left = self.range[short] << _WORD
            self.range[short] = left
            short = short[left < _SHORT]

    def event(self, first: np.ndarray, second: np.ndarray, past: np.ndarray, far: np.ndarray) -> None:
        """``past`` the first event, ``far``: past the second one too."""
        m = len(first)
        whole, (unit, start, stop) = self.range[:m], self.room[:, :m]
        between = second - first
        np.right_shift(whole, _BITS, out=unit)
        np.multiply(first * past + between * far, unit, out=start)
        np.multiply(first + between * past, unit, out=stop)
        # The last event takes all that is left.
        np.subtract(whole, stop, out=unit)
        unit *= far
        stop += unit
        np.subtract(stop, start, out=whole)
        self.low[:m] += start

    def parts(self, far: np.ndarray, start: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        """``part`` of the lanes marked in ``far``, with totals as floats: quotients of numbers below 2**48 are cut right."""
        m = len(far)
        whole, ratio, (unit, low, left) = self.range[:m], self.ratio[:m], self.room[:, :m]
        np.divide(whole, total, out=ratio)
        unit[:] = ratio
        np.multiply(start, unit, out=low)
        low *= far
        self.low[:m] += low
        np.multiply(size, unit, out=left)
        whole[:] = np.where(far, left, whole)

    def part(self, lanes: np.ndarray, start: np.ndarray, size: np.ndarray, total: np.ndarray | int) -> None:
        unit = self.range[lanes] // total
        self.low[lanes] += start * unit
        self.range[lanes] = size * unit

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(2):
            self._shift(every)
        rows = int(self.at.max())
        for row in range(rows - 1, 0, -1):
            self.words[row - 1] += self.words[row] >> _WORD
        wide = _turned(self.words[:rows].astype("<u4", copy=False)).view(np.uint8)
        lines = np.empty((len(wide), 3 * rows), np.uint8)
        for k in range(3):
            lines[:, k::3] = wide[:, k::4]
        return [line[: 3 * n].tobytes() for line, n in zip(lines, self.at.tolist())]


class _Decoder:
    """The same ranges, and how far the code lies above their low ends."""

    def __init__(self, payloads: list[bytes]):
        lanes = len(payloads)
        # Empty words behind the last one keep a damaged block from reading outside.
        narrow = np.frombuffer(b"".join(payloads) + b"\0" * 12, np.uint8)
        wide = np.zeros((len(narrow) // 3, 4), np.uint8)
        for k in range(3):
            wide[:, k] = narrow[k::3][: len(wide)]
        self.words = wide.reshape(-1).view("<u4").astype(np.int32, copy=False)
        sizes = np.array([len(p) // 3 for p in payloads], np.int64)
        self.at = np.cumsum(sizes) - sizes
        self.value = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, (1 << 48) - 1, np.int64)
        self.room = np.empty((4, lanes), np.int64)
        self.ratio = np.empty(lanes)
        every = np.arange(lanes)
        for _ in range(2):
            self._shift(every)

    def _shift(self, lanes: np.ndarray) -> None:
        at = self.at[lanes]
        self.value[lanes] = (self.value[lanes] << _WORD) | self.words.take(at, mode="clip")
        self.at[lanes] = at + 1

    settle = _Encoder.settle

    def event(self, first: np.ndarray, second: np.ndarray, past: np.ndarray, far: np.ndarray) -> None:
        m = len(first)
        whole, value, (unit, a, b, stop) = self.range[:m], self.value[:m], self.room[:, :m]
        np.right_shift(whole, _BITS, out=unit)
        np.multiply(first, unit, out=a)
        np.multiply(second, unit, out=b)
        np.greater_equal(value, a, out=past)
        np.greater_equal(value, b, out=far)
        np.subtract(whole, b, out=unit)
        unit *= far
        b -= a
        np.multiply(b, past, out=stop)
        stop += a
        stop += unit
        a *= past
        b *= far
        a += b
        np.subtract(stop, a, out=whole)
        value -= a

    def place(self, total: np.ndarray) -> np.ndarray:
        """Where the code of every lane points among its ``total`` (floats, as in ``parts``); the unit is in ``room[0]``."""
        m = len(total)
        ratio, (unit, place) = self.ratio[:m], self.room[:2, :m]
        np.divide(self.range[:m], total, out=ratio)
        unit[:] = ratio
        # Only lanes that need no place can have so small a range.
        np.maximum(unit, 1, out=unit)
        np.divide(self.value[:m], unit, out=ratio)
        place[:] = ratio
        return place

    def parts(self, far: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Goes on in the part that ``place`` found, in the lanes marked in ``far``."""
        m = len(far)
        whole, (unit, _, low, left) = self.range[:m], self.room[:, :m]
        np.multiply(start, unit, out=low)
        low *= far
        self.value[:m] -= low
        np.multiply(size, unit, out=left)
        whole[:] = np.where(far, left, whole)


class _Order0:
    """Counts of the ids among the last ones of each lane; ids met once foretell how many new ones come."""

    def __init__(self, lanes: int, ids: np.ndarray | None):
        self.lanes, self.ids = lanes, ids
        self.window = 0
        self.new = np.empty(lanes, np.int32)
        self.room = None
        self.table = None if ids is None else np.zeros(_SHARED << 16, np.int32)

    def recount(self, before: np.ndarray, step: int) -> None:
        """``before`` is (step, lane): all ids so far. A few lanes at a time, so that what is between stays in the cache."""
        window = min(_WINDOW, step)
        self.window, self.first = window, step
        if self.ids is None:
            if self.room is None:
                self.room = np.empty(self.lanes * _WINDOW, np.int64)
            self.known = self.room[: self.lanes * window]
            self.begin = np.arange(self.lanes) * window
        else:
            self.ahead = np.empty((len(self.ids[step : step + min(step, _RECOUNT)]), self.lanes), np.int32)
        for a in range(0, self.lanes, _GROUP):
            self._recount(before[step - window : step, a : a + _GROUP], slice(a, min(a + _GROUP, self.lanes)))
        self.total = (window + self.new).astype(np.float64)

    def _recount(self, before: np.ndarray, group: slice) -> None:
        window, lanes = before.shape
        some = np.sort(_turned(before).astype(np.uint32), axis=1)
        edge = np.ones((lanes, window), bool)
        edge[:, 1:] = some[:, 1:] != some[:, :-1]
        # An id is there once if it and what follows it both start a run.
        self.new[group] = 1 + np.count_nonzero(edge[:, :-1] & edge[:, 1:], axis=1) + edge[:, -1]
        first = np.flatnonzero(edge)
        size = np.diff(first, append=lanes * window)
        lane = first // window
        start = first - lane * window
        some = some.ravel()[first].astype(np.int64)
        if self.ids is None:
            self.known[group.start * window : group.stop * window] = np.repeat(size << 32 | start << 16 | some, size)
            return
        # What each id of the next steps will need; some lanes share a table over all ids. New ids lie behind the window.
        ahead = _turned(self.ids[self.first : self.first + len(self.ahead), group])
        met = (lane % _SHARED << 16) + some
        need = (start << 12 | size).astype(np.int32)
        behind = (window << 12 | self.new[group])[:, None]
        cut = np.searchsorted(lane, np.arange(0, lanes + _SHARED, _SHARED))
        out = np.empty(ahead.shape, np.int32)
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            rows = slice(k * _SHARED, min((k + 1) * _SHARED, lanes))
            here = (np.arange(rows.stop - rows.start) << 16)[:, None] + ahead[rows]
            self.table[met[a:b]] = need[a:b]
            self.table.take(here, out=out[rows], mode="clip")
            self.table[met[a:b]] = 0
        out += (out == 0) * behind
        self.ahead[:, group] = _turned(out)

    def encode(self, coder: _Encoder, far: np.ndarray, now: np.ndarray, step: int) -> None:
        """The ids ``now`` of the lanes marked in ``far``."""
        if self.window:
            ahead = self.ahead[step - self.first, : len(far)]
            start = ahead >> 12
            coder.parts(far, start, ahead & 0xFFF, self.total[: len(far)])
            far = far & (start == self.window)
        lanes = np.flatnonzero(far)
        if len(lanes):
            coder.settle(lanes)
            coder.part(lanes, now[lanes], 1, 1 << 16)

    def decode(self, coder: _Decoder, far: np.ndarray, now: np.ndarray) -> None:
        """Puts the ids of the lanes marked in ``far`` into ``now``."""
        if not self.window:
            lanes = np.flatnonzero(far)
        else:
            m, last = len(far), self.window - 1
            place = coder.place(self.total[:m])
            lanes = np.flatnonzero(far & (place > last))
            np.minimum(place, last, out=place)
            # Lanes that need nothing look at their first place, which is near.
            place *= far
            place += self.begin[:m]
            known = self.known.take(place, mode="clip")
            lower, size = known.astype(np.int32), known >> 32
            now[:] = np.where(far, lower & 0xFFFF, now)
            start = lower >> 16
            start[lanes], size[lanes] = self.window, self.new.take(lanes)
            coder.parts(far, start, size)
        if len(lanes):
            now[lanes] = self._bare(coder, lanes)

    @staticmethod
    def _bare(coder: _Decoder, lanes: np.ndarray) -> np.ndarray:
        coder.settle(lanes)
        unit = coder.range[lanes] >> 16
        value = coder.value[lanes]
        now = np.minimum(value // unit, 0xFFFF)
        coder.value[lanes] = value - now * unit
        coder.range[lanes] = unit
        return now


def _rooms(lanes: int) -> tuple[np.ndarray, ...]:
    """Arrays for what a step computes per order and lane: two wide ones, ten narrow ones, hash bits, hits, and three masks per lane."""
    return (
        np.empty((2, 2, lanes), np.int64), np.empty((10, 2, lanes), np.int32), np.empty((2, lanes), np.uint32),
        np.empty((2, lanes), bool), np.empty((3, lanes), bool),
    )


def _run(coder: _Encoder | _Decoder, ids: np.ndarray | None, lengths: np.ndarray) -> np.ndarray:
    """Codes all blocks side by side; ``ids`` is (step, lane), or None to decode. Only the last lane may be shorter."""
    lanes, steps = len(lengths), int(lengths[0])
    decoded = np.zeros((steps, lanes), np.uint16) if ids is None else ids
    order0 = _Order0(lanes, ids)
    # Rows of what follows: order 1, order 2. A table's entry is the id seen last and, above it, how sure it is.
    table = np.zeros(lanes << _TABLE + 1, np.int32)
    right = np.tile(_RIGHT, 2 * lanes)
    # Weights lie under the states of order 2, so the first half is not used.
    weight = np.full(2 * lanes * (_SURE + 1), _ONE // 8 * 5, np.int32)
    every = np.arange(2 * lanes).reshape(2, lanes)
    base, sure0 = (np.arange(lanes) << _TABLE + 1) + np.array([[0], [8]]), every * (_SURE + 1)
    mixed = np.zeros((2, lanes), np.uint32)
    m = lanes
    # Every step works in the same arrays, and masks are multiplied: fresh arrays and choices by mask cost more than the sums.
    wide, narrow, key, hit, masks = _rooms(m)
    for step in range(steps):
        if step == int(lengths[-1]):
            m -= 1
            base, sure0, mixed = (np.ascontiguousarray(x[:, :m]) for x in (base, sure0, mixed))
            wide, narrow, key, hit, masks = _rooms(m)
        if step >= _FIRST_COUNT and (step & (step - 1) == 0 or step % _RECOUNT == 0):
            order0.recount(decoded, step)
        (at, state), (slot, named, sure, chance, change), (w, first, second, mass, now) = wide, narrow[:5], narrow[5:, 0]
        same, past, far = masks
        np.right_shift(mixed[0], np.uint32(21), out=key[0])
        np.bitwise_and(key[0], np.uint32(0x7F8), out=key[1])
        key[0] += key[1]
        key[1] <<= 1
        key[1] += mixed[1] >> np.uint32(29)
        np.add(base, key, out=at)
        table.take(at, out=slot, mode="clip")
        np.bitwise_and(slot, 0xFFFF, out=named)
        np.right_shift(slot, 16, out=sure)
        np.add(sure0, sure, out=state)
        right.take(state, out=chance, mode="clip")
        weight.take(state[1], out=w, mode="clip")
        np.multiply(chance[1], w, out=first)
        first >>= _BITS
        first += 1
        np.subtract(_ONE, w, out=mass)
        mass *= chance[0]
        mass >>= _BITS
        mass += 1
        np.add(first, mass, out=second)
        # Where both name the same id, the first takes the share of the second.
        np.equal(named[0], named[1], out=same)
        mass *= same
        first += mass
        if ids is not None:
            now[:] = ids[step, :m]
            np.equal(named, now, out=hit)
            np.logical_not(hit[1], out=past)
            np.greater(past, hit[0], out=far)
            coder.event(first, second, past, far)
            order0.encode(coder, far, now, step)
        else:
            coder.event(first, second, past, far)
            np.subtract(named[0], named[1], out=now)
            now *= past
            now += named[1]
            order0.decode(coder, far, now)
            decoded[step, :m] = now
            np.equal(named, now, out=hit)
        coder.settle()
        hits = slot
        hits[:] = hit
        np.multiply(hits, _SPAN, out=change)
        change -= chance
        change += _LOW
        change >>= _RATE
        change += chance
        right[state] = change
        np.subtract(hits[1], hits[0], out=mass)
        mass *= _STEP
        w += mass
        np.maximum(w, _STEP, out=w)
        np.minimum(w, _ONE - _STEP, out=w)
        weight[state[1]] = w
        sure *= hits
        np.minimum(sure, _SURE - 1, out=sure)
        sure += 1
        sure <<= 16
        sure += now
        table[at] = sure
        np.right_shift(mixed[0], np.uint32(5), out=mixed[1])
        np.multiply(now.view(np.uint32), _HASH, out=mixed[0])
        mixed[1] ^= mixed[0]
        mixed[1] *= _HASH
    return decoded


def block_size(n: int) -> int:
    """Ids per block for ``n`` ids: smaller for short segments, so that there are lanes to fill."""
    size = SMALLEST_BLOCK
    while size < BLOCK and size * LANES < n:
        size *= 2
    return size


def _lanes(count: int) -> int:
    """Blocks coded side by side: about as many in every round. Blocks do not depend on it."""
    rounds = max(1, -(-count // LANES))
    return max(1, -(-count // rounds))


def encode(ids: np.ndarray, block: int | None = None) -> bytes:
    """A segment: head, per block the CRC-32 of its ids and of its code and the code's length, CRC-32 of all that, codes."""
    ids = np.ascontiguousarray(ids)
    if len(ids) and int(ids.max()) > MOST_ID:
        raise ValueError(f"ids above {MOST_ID} do not fit this format")
    n = len(ids)
    block = block or block_size(n)
    count = -(-n // block)
    payloads: list[bytes] = []
    per = _lanes(count)
    for part in range(0, count, per):
        some = ids[part * block : (part + per) * block]
        lengths = np.full(-(-len(some) // block), block, np.int64)
        lengths[-1] = len(some) - block * (len(lengths) - 1)
        padded = np.zeros(len(lengths) * block, np.uint16)
        padded[: len(some)] = some
        coder = _Encoder(len(lengths), block // 4 * 3)
        _run(coder, _turned(padded.reshape(len(lengths), block)), lengths)
        payloads += coder.finish()
    table = np.array(
        [(zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()), zlib.crc32(p), len(p)) for k, p in enumerate(payloads)], dtype="<u4"
    ).reshape(-1, 3)
    head = _HEAD.pack(_MAGIC, _VERSION, 0, block, n) + table.tobytes()
    return b"".join([head, _CRC.pack(zlib.crc32(head)), *payloads])


def decode(segment: bytes) -> np.ndarray:
    """The ids of a segment; ValueError names the first block whose checksum differs."""
    if len(segment) < _HEAD.size + 4:
        raise ValueError("segment too short")
    magic, version, _, block, n = _HEAD.unpack_from(segment)
    if magic != _MAGIC or version != _VERSION or block == 0:
        raise ValueError("not a token segment")
    count = -(-n // block)
    end = _HEAD.size + 12 * count
    if len(segment) < end + 4 or _CRC.unpack_from(segment, end)[0] != zlib.crc32(segment[:end]):
        raise ValueError("head of the segment is damaged")
    table = np.frombuffer(segment, "<u4", 3 * count, _HEAD.size).reshape(count, 3).astype(np.int64)
    stops = end + 4 + np.cumsum(table[:, 2])
    payloads = [segment[b - size : b] for b, size in zip(stops.tolist(), table[:, 2].tolist())]
    for k, payload in enumerate(payloads):
        if zlib.crc32(payload) != table[k, 1]:
            raise ValueError(f"code of block {k} is damaged")
    out = np.empty(n, "<u4")
    per = _lanes(count)
    for part in range(0, count, per):
        some = payloads[part : part + per]
        lengths = np.full(len(some), block, np.int64)
        lengths[-1] = min(block, n - block * (part + len(some) - 1))
        ids = _turned(_run(_Decoder(some), None, lengths)).reshape(-1)
        out[part * block : part * block + len(ids)] = ids[: int(lengths.sum())]
    for k in range(count):
        if zlib.crc32(out[k * block : (k + 1) * block].tobytes()) != table[k, 0]:
            raise ValueError(f"ids of block {k} are damaged")
    return out
