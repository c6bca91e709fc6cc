"""Passages that also start in a document with a smaller id: the frame shared by the two substring operators.

A window is ``WINDOW`` consecutive units (words or bytes) of one document. Of the
k-grams in a window the one with the least hash is its anchor, so equal windows
have equal anchors, and a run of windows with one anchor is one *context*.

1. *Anchors.* Each task sends the anchors of its documents, packed, to buckets
   by hash; a bucket says which are held by two documents or more. An anchor
   that a task itself sees in several documents is sent once, so a passage that
   a third of all documents share costs one entry per task.
2. *Contexts* of shared anchors only. Equal contexts are combined in the slice
   (only the smallest id travels, the other copies are covered), then in the
   bucket of their anchor, where a matcher compares the different contexts of an
   anchor. Anchors held by a thousandth of all documents or more are listed
   first (there are few) and handled window by window instead, each window in
   the bucket of its own hash, so no bucket meets all contexts of a hot anchor.
3. Covered spans go back to their documents.

Nothing is sampled: every window has an anchor, so every repeated window is met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotide.llm.words import mix, shingles, slices, span_hashes, split
from heliotide.llm.settle import settled

WINDOW = 50
#: Grams are long enough that few texts share one by chance.
WORD_GRAM, BYTE_GRAM = 8, 16
HOT_SHARE = 1000
LEAST_HOT = 1000
LEAST_BUCKETS, LEAST_CONTEXT_BUCKETS = 16, 128
#: Bytes of text per bucket, for anchors and for contexts.
BUCKET_BYTES, CONTEXT_BUCKET_BYTES = 64 << 20, 8 << 20
SLICE_BYTES = 1 << 19
FLUSH_ANCHORS = 1 << 21
FLUSH_CONTEXTS = 1 << 18
_CONTEXT_BASE = 0xA24BAED4963EE407
_LOW48 = np.uint64((1 << 48) - 1)

#: (contents, ids): per content, whether each of its windows also occurs in a content with a smaller id.
Matcher = Callable[[list[bytes], list[int]], list[np.ndarray]]


@dataclass
class Units:
    """Units of the texts of a slice: text t has ``values[first[t]:first[t+1]]``."""

    values: np.ndarray
    first: np.ndarray
    content: Callable[[int, int], bytes]


def words_as_units(data: np.ndarray, texts: np.ndarray) -> Units:
    words = split(data, texts)

    def content(a: int, b: int) -> bytes:
        return b" ".join(data[s:e].tobytes() for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist()))

    return Units(words.hashes, words.first.astype(np.int64), content)


def bytes_as_units(data: np.ndarray, texts: np.ndarray) -> Units:
    return Units(data, texts, lambda a, b: data[a:b].tobytes())


def gram_of(values: np.ndarray) -> int:
    return BYTE_GRAM if values.dtype == np.uint8 else WORD_GRAM


def _grams(values: np.ndarray) -> np.ndarray:
    if values.dtype != np.uint8:
        return shingles(values, WORD_GRAM)
    n = len(values) - BYTE_GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # The eight bytes from every place on, read as numbers at eight shifts.
    half = BYTE_GRAM // 2
    eight = np.empty(n + half, dtype=np.uint64)
    padded = np.append(values, np.zeros(2 * half, np.uint8))
    for shift in range(half):
        part = eight[shift::half]
        part[:] = np.frombuffer(padded, "<u8", len(part), shift)
    return mix(mix(eight[:n] + np.uint64(0x632BE59BD9B4E019)) + eight[half:])


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The first place of the least value in every ``width`` consecutive ones.

    Blocks of ``width`` are scanned from both ends; a window is the end of one block and the start of the next.
    """
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, np.int64)
    blocks = -(-len(values) // width) + 1
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(values)] = values
    rows = np.ascontiguousarray(padded.reshape(blocks, width).T)
    kind = np.uint8 if width <= 256 else np.int64
    until, since = rows.copy(), rows.copy()
    first_until, first_since = np.zeros(rows.shape, kind), np.full(rows.shape, width - 1, kind)
    for k in range(1, width):
        np.minimum(rows[k], until[k - 1], out=until[k])
        first_until[k] = np.where(rows[k] < until[k - 1], kind(k), first_until[k - 1])
    for k in range(width - 2, -1, -1):
        np.minimum(rows[k], since[k + 1], out=since[k])
        first_since[k] = np.where(rows[k] <= since[k + 1], kind(k), first_since[k + 1])
    out = np.empty((width, blocks - 1), np.int64)
    base = np.arange(blocks - 1) * width
    out[0] = base + first_since[0, :-1]
    for k in range(1, width):
        later = until[k - 1, 1:] < since[k, :-1]
        out[k] = base + np.where(later, first_until[k - 1, 1:].astype(np.int64) + width, first_since[k, :-1])
    return out.T.reshape(-1)[:count]


def contexts(units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, anchor place, first window, end window) of each run of windows with one anchor."""
    grams = _grams(units.values)
    n = len(units.values) - WINDOW + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, np.empty(0, np.uint64), none, none, none
    at = least_places(grams, WINDOW - gram_of(units.values) + 1)
    windows = np.maximum(np.diff(units.first) - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(windows)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(units.first[:-1], windows)
    place = at[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(start)) - 1 if len(head) else head
    return text[head], grams[place[head]], place[head], start[head], start[last] + 1


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the sorted ``keys`` begins."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _packed(values: np.ndarray) -> bytes:
    """Places of some texts, in two bytes each, or four (eight) where a text is too long."""
    most = int(values.max()) if len(values) else 0
    kind = np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {2: np.uint16, 4: np.uint32, 8: np.int64}[raw[0]], offset=1).astype(np.int64)


def _int64(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


_STAGE1 = pa.schema([
    ("bucket", pa.int32()), ("docs", pa.binary()), ("anchors", pa.binary()), ("places", pa.binary()), ("several", pa.binary()), ("row_key", pa.int64()),
])
_STAGE1_DDL = "bucket int, docs binary, anchors binary, places binary, several binary, row_key bigint"
_SHARED = pa.schema([("row_key", pa.int64()), ("places", pa.binary()), ("hot", pa.int64()), ("n", pa.int64())])
_SHARED_DDL = "row_key bigint, places binary, hot bigint, n bigint"
_SPANS = pa.schema([("row_key", pa.int64()), ("spans", pa.binary())])


def _send_anchors(buckets: int, as_units: Callable):
    """Anchors of all texts, packed per bucket; many texts go together, so a row holds many anchors also if there are many buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, docs = [], 0, 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            for row, last, data, texts in slices(batch.column("text"), SLICE_BYTES):
                units = as_units(data, texts)
                text, anchor, place, _, _ = contexts(units)
                parts.append((anchor, (docs + text).astype(np.int32), ids[row:last][text], keys[row:last][text], (place - units.first[text]).astype(np.uint32)))
                docs += last - row
                n += len(text)
                if n >= FLUSH_ANCHORS:
                    yield _anchor_rows(parts, buckets)
                    parts, n = [], 0
        if n:
            yield _anchor_rows(parts, buckets)

    return run


def _anchor_rows(parts: list[tuple[np.ndarray, ...]], buckets: int) -> pa.RecordBatch:
    anchor, doc, own, key, place = (np.concatenate(c) for c in zip(*parts))
    parts.clear()
    out = []
    order = np.lexsort((own, anchor))
    a, d = anchor[order], own[order]
    head = np.flatnonzero(_first_of(a))
    low, high = d[head], np.maximum.reduceat(d, head)
    local = low != high
    n_docs = np.add.reduceat(_first_of(a, d).astype(np.int64), head)
    mine = np.zeros(len(a), dtype=bool)
    mine[order] = np.repeat(local, np.diff(np.append(head, len(a))))
    shared = np.column_stack([(a[head][local] & _LOW48).astype(np.int64), low[local], high[local], n_docs[local]])
    to_shared = _bucket(a[head][local], buckets)
    del a, d, order, low, high, n_docs, head
    # Known to be shared already: the places need no answer, the anchor is sent once.
    for t, where in _by(doc[mine], np.flatnonzero(mine)):
        out.append({"bucket": int(key[where[0]] % buckets), "row_key": int(key[where[0]]), "places": _packed(np.sort(place[where]))})
    alone = np.flatnonzero(~mine)
    to = _bucket(anchor[alone], buckets)
    alone = alone[np.lexsort((place[alone], doc[alone], to))]
    to = np.sort(to)
    for b in np.union1d(to, to_shared).tolist():
        pick = alone[np.searchsorted(to, b) : np.searchsorted(to, b, side="right")]
        first = np.flatnonzero(_first_of(doc[pick]))
        count = np.diff(np.append(first, len(pick)))
        out.append({
            "bucket": b, "docs": np.column_stack([own[pick][first], key[pick][first], count]).astype(np.int64).tobytes(),
            "anchors": np.ascontiguousarray(anchor[pick].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(),
            "places": _packed(place[pick]), "several": shared[to_shared == b].tobytes(),
        })
    return pa.RecordBatch.from_pylist(out, schema=_STAGE1)


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """From all bits, as rows carry 48 of them: what meets in a bucket differs in those or is equal."""
    return (mix(anchor) % np.uint64(buckets)).astype(np.int64)


def _by(group: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, its values) for each group."""
    order = np.argsort(group, kind="stable")
    group, values = group[order], values[order]
    head = np.flatnonzero(_first_of(group))
    for a, b in zip(head.tolist(), np.append(head[1:], len(group)).tolist()):
        yield int(group[a]), values[a:b]


def _meet_anchors(hot_at: int):
    def run(table: pa.Table) -> pa.Table:
        # Column by column into arrays of known size: a bucket holds millions of anchors, and two tasks share a small executor.
        at = lambda name, i: table.column(name)[i].as_py()
        keys = table.column("row_key").to_pylist()
        out = [{"row_key": k, "places": at("places", i)} for i, k in enumerate(keys) if k is not None]
        sent = [i for i, k in enumerate(keys) if k is None]
        if sent:
            more = np.concatenate([_int64(at("several", i)) for i in sent]).reshape(-1, 4)
            docs = np.concatenate([_int64(at("docs", i)) for i in sent]).reshape(-1, 3)
            n_one, n_more = int(docs[:, 2].sum()), len(more)
            a, places, done = np.zeros(n_one + 2 * n_more, np.int64), np.empty(n_one, np.uint32), 0
            for i in sent:
                raw = np.frombuffer(at("anchors", i), np.uint8).reshape(-1, 6)
                a[done : done + len(raw)].view(np.uint8).reshape(-1, 8)[:, :6] = raw
                places[done : done + len(raw)] = _unpacked(at("places", i))
                done += len(raw)
            a[n_one : n_one + n_more] = a[n_one + n_more :] = more[:, 0]
            own = np.repeat(np.arange(len(docs), dtype=np.int32), docs[:, 2])
            order = np.argsort(a)
            a = a[order]
            head = np.flatnonzero(_first_of(a))
            size = np.diff(np.append(head, len(a)))
            n = np.ones(len(a), np.int32)
            n[n_one : n_one + n_more], n[n_one + n_more :] = more[:, 3], 0
            total = np.add.reduceat(n[order], head, dtype=np.int64)
            for x, c in zip(a[head][total >= hot_at].tolist(), total[total >= hot_at].tolist()):
                out.append({"hot": x, "n": c})
            del a, n
            d = np.concatenate([docs[own, 0], more[:, 1], more[:, 2]])[order]
            shared = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
            del d
            is_shared = np.zeros(len(order), dtype=bool)
            is_shared[order] = np.repeat(shared, size)
            del order
            pick = np.flatnonzero(is_shared[:n_one])
            out += [{"row_key": k, "places": _packed(np.sort(p))} for k, p in _by(docs[own[pick], 1], places[pick])]
        return pa.Table.from_pylist(out, schema=_SHARED)

    return run


_STAGE2 = pa.schema([
    ("bucket", pa.int32()), ("docs", pa.binary()), ("anchors", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary()),
    ("content", pa.binary()), ("windows", pa.binary()), ("row_key", pa.int64()), ("spans", pa.binary()),
])
_STAGE2_DDL = (
    "bucket int, docs binary, anchors binary, starts binary, counts binary, sizes binary, content binary, windows binary, row_key bigint, spans binary"
)


def _later_copies(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by ``keys``, the last being the doc_id, and whether an entry repeats the other keys of one with a smaller id."""
    order = np.lexsort(keys[::-1])
    doc = keys[-1][order]
    head = _first_of(*(k[order] for k in keys[:-1]))
    return order, doc > doc[head][np.cumsum(head) - 1] if len(doc) else np.zeros(0, bool)


def _send_contexts(buckets: int, as_units: Callable, hot: np.ndarray):
    """Different contexts of shared anchors, each with the smallest id that this task saw; spans of all other copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold, warm, contents = [], [], []
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            shared = batch.column("places")
            for row, last, data, texts in slices(batch.column("text"), SLICE_BYTES):
                units = as_units(data, texts)
                known = np.concatenate([np.empty(0, np.int64)] + [
                    np.concatenate([_unpacked(p) for p in shared[row + t].as_py()]) + units.first[t] for t in range(last - row)
                ])
                text, anchor, place, start, end = contexts(units)
                keep = np.flatnonzero(np.isin(place, known))
                text, anchor, start, end = text[keep], anchor[keep], start[keep], end[keep]
                whole = span_hashes(units.values, start, end + WINDOW - 1, _CONTEXT_BASE)
                order, copy = _later_copies(anchor, whole, ids[row:last][text])
                text, anchor, start, end, whole = (x[order] for x in (text, anchor, start, end, whole))
                doc, key, inside = ids[row:last][text], keys[row:last][text], start - units.first[text]
                yield from _span_rows(key[copy], np.column_stack([inside, inside + (end - start) + WINDOW - 1])[copy], buckets)
                is_hot = np.isin((anchor & _LOW48).astype(np.int64), hot)
                pick = np.flatnonzero(~copy & ~is_hot)
                cold.append(np.column_stack([anchor[pick].view(np.int64), whole[pick].view(np.int64), doc[pick], key[pick], inside[pick], (end - start)[pick]]))
                contents += [units.content(a, b) for a, b in zip(start[pick].tolist(), (end[pick] + WINDOW - 1).tolist())]
                pick = np.flatnonzero(~copy & is_hot)
                count = (end - start)[pick]
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(start[pick], count) + step
                window = span_hashes(units.values, at, at + WINDOW, _CONTEXT_BASE)
                warm.append(np.column_stack([window.view(np.int64), np.repeat(doc[pick], count), np.repeat(key[pick], count), np.repeat(inside[pick], count) + step]))
                if len(contents) + sum(map(len, warm)) // 8 >= FLUSH_CONTEXTS:
                    yield from _context_rows(np.concatenate(cold), contents, np.concatenate(warm), buckets)
                    cold, warm, contents = [], [], []
        if cold:
            yield from _context_rows(np.concatenate(cold), contents, np.concatenate(warm), buckets)

    return run


def _span_rows(key: np.ndarray, spans: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    out = [{"bucket": int(k % buckets), "row_key": k, "spans": _union(s).tobytes()} for k, s in _by(key, spans)]
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_STAGE2)


def _context_rows(entry: np.ndarray, contents: list[bytes], windows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    order, copy = _later_copies(entry[:, 0], entry[:, 1], entry[:, 2])
    gone = entry[order[copy]]
    yield from _span_rows(gone[:, 3], np.column_stack([gone[:, 4], gone[:, 4] + gone[:, 5] + WINDOW - 1]), buckets)
    left = order[~copy]
    to = (entry[left, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    # By bucket, then by document, so a document is named once per row.
    again = np.lexsort((entry[left, 4], entry[left, 3], to))
    left, to = left[again], to[again]
    order, copy = _later_copies(windows[:, 0], windows[:, 1])
    gone = windows[order[copy]]
    yield from _span_rows(gone[:, 2], np.column_stack([gone[:, 3], gone[:, 3] + WINDOW]), buckets)
    windows = windows[order[~copy]]
    to_window = (windows[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    out = []
    for b in np.union1d(to, to_window).tolist():
        pick = left[np.searchsorted(to, b) : np.searchsorted(to, b, side="right")]
        e = entry[pick]
        first = np.flatnonzero(_first_of(e[:, 3]))
        docs = np.column_stack([e[first, 2], e[first, 3], np.diff(np.append(first, len(e)))])
        parts = [contents[i] for i in pick.tolist()]
        out.append({
            "bucket": b, "docs": docs.astype(np.int64).T.tobytes(), "anchors": e[:, 0].tobytes(), "starts": _packed(e[:, 4]), "counts": _packed(e[:, 5]),
            "sizes": _packed(np.array([len(p) for p in parts], dtype=np.int64)), "content": b"".join(parts), "windows": windows[to_window == b].T.tobytes(),
        })
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_STAGE2)


def _union(spans: np.ndarray) -> np.ndarray:
    """Ascending disjoint spans (start, end) that cover the same places; touching spans join."""
    if not len(spans):
        return spans.reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), dtype=bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    head = np.flatnonzero(new)
    return np.column_stack([spans[head, 0], reach[np.append(head[1:], len(spans)) - 1]])


def _batches(edges: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Neighbouring groups (between consecutive ``edges``) put together until they have ``size`` members or more.

    Windows of different anchors are different, so groups do not disturb each other.
    """
    first = 0
    for k, edge in enumerate(edges):
        if edge - first >= size or (k == len(edges) - 1 and edge > first):
            yield first, edge
            first = edge


def _meet_contexts(matcher: Matcher, batch: int):
    def run(table: pa.Table) -> pa.Table:
        out, entries, contents, windows = [], [], [], []
        for r in table.to_pylist():
            if r["row_key"] is not None:
                out.append({"row_key": r["row_key"], "spans": r["spans"]})
                continue
            docs = _int64(r["docs"]).reshape(3, -1)
            ends = np.cumsum(_unpacked(r["sizes"]))
            whole = span_hashes(np.frombuffer(r["content"], np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)], ends, _CONTEXT_BASE)
            entries.append(np.column_stack([
                _int64(r["anchors"]), whole.view(np.int64), np.repeat(docs[0], docs[2]), np.repeat(docs[1], docs[2]), _unpacked(r["starts"]), _unpacked(r["counts"]),
            ]))
            ends = ends.tolist()
            contents += [r["content"][a:b] for a, b in zip([0, *ends[:-1]], ends)]
            windows.append(_int64(r["windows"]).reshape(4, -1).T)
        keys, spans = [], []
        if entries:
            e = np.concatenate(entries)
            order = np.lexsort((e[:, 2], e[:, 1], e[:, 0]))
            e = e[order]
            head = _first_of(e[:, 0], e[:, 1])
            group = np.cumsum(head) - 1
            least = e[head, 2]
            copy = e[:, 2] > least[group] if len(e) else np.zeros(0, bool)
            keys.append(e[copy, 3])
            spans.append(np.column_stack([e[copy, 4], e[copy, 4] + e[copy, 5] + WINDOW - 1]))
            # Different contexts of one anchor may still share windows.
            lead = np.flatnonzero(head)
            anchor = e[lead, 0]
            several = np.zeros(len(lead), dtype=bool)
            several[1:] |= anchor[1:] == anchor[:-1]
            several[:-1] |= anchor[1:] == anchor[:-1]
            edge = np.flatnonzero(_first_of(anchor[several])) if several.any() else np.empty(0, np.int64)
            lead_of = np.flatnonzero(several)
            for a, b in _batches(np.append(edge, len(lead_of)).tolist(), batch):
                members = lead_of[a:b]
                hits = matcher([contents[order[lead[g]]] for g in members.tolist()], [int(least[g]) for g in members.tolist()])
                for g, hit in zip(members.tolist(), hits):
                    at = np.flatnonzero(hit)
                    if len(at):
                        same = np.arange(lead[g], lead[g + 1] if g + 1 < len(lead) else len(e))
                        for i in same[~copy[same]].tolist():
                            keys.append(np.full(len(at), e[i, 3]))
                            spans.append(np.column_stack([e[i, 4] + at, e[i, 4] + at + WINDOW]))
            w = np.concatenate(windows)
            w = w[np.lexsort((w[:, 1], w[:, 0]))]
            head = _first_of(w[:, 0])
            copy = w[:, 1] > w[head, 1][np.cumsum(head) - 1] if len(w) else np.zeros(0, bool)
            keys.append(w[copy, 2])
            spans.append(np.column_stack([w[copy, 3], w[copy, 3] + WINDOW]))
            out += [{"row_key": k, "spans": _union(s).tobytes()} for k, s in _by(np.concatenate(keys), np.concatenate(spans))]
        return pa.Table.from_pylist(out, schema=_SPANS)

    return run


def covered(docs: DataFrame, as_units: Callable, matcher: Matcher, hot_docs: int | None = None, batch: int = 1) -> DataFrame:
    """``docs`` (``doc_id, text``) with ``spans``: array of packed spans of covered units, null if there are none.

    A null text is empty. A row without doc_id neither covers nor is covered;
    rows with one doc_id do not cover each other. ``hot_docs`` (default: a
    thousandth of all rows, 1000 at least) sets from how many documents on an
    anchor is hot, ``batch`` how many contexts the
    matcher gets at least; the result depends on neither.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("row_key")
    )
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(LEAST_BUCKETS, -(-(size["b"] or 0) // BUCKET_BYTES))
    context_buckets = max(LEAST_CONTEXT_BUCKETS, -(-(size["b"] or 0) // CONTEXT_BUCKET_BYTES))
    hot_docs = hot_docs or max(LEAST_HOT, size["n"] // HOT_SHARE)
    able = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").where(F.octet_length("text") >= WINDOW)
    shared = settled(able.mapInArrow(_send_anchors(buckets, as_units), _STAGE1_DDL).groupBy("bucket").applyInArrow(_meet_anchors(hot_docs), _SHARED_DDL))
    # At most HOT_SHARE times the anchors of a mean document.
    hot = np.array([r["hot"] for r in shared.where("hot IS NOT NULL").select("hot").collect()], dtype=np.int64)
    places = shared.where("row_key IS NOT NULL").groupBy("row_key").agg(F.collect_list("places").alias("places"))
    sent = able.join(places, "row_key").select("doc_id", "row_key", "text", "places").mapInArrow(_send_contexts(context_buckets, as_units, hot), _STAGE2_DDL)
    spans = settled(sent.groupBy("bucket").applyInArrow(_meet_contexts(matcher, batch), "row_key bigint, spans binary"))
    return rows.join(spans.groupBy("row_key").agg(F.collect_list("spans").alias("spans")), "row_key", "left").select("doc_id", "text", "spans")


def spans_of(packed: list[bytes] | None) -> np.ndarray:
    """Ascending disjoint covered spans (start, end) of one row."""
    return _union(np.concatenate([_int64(p).reshape(-1, 2) for p in packed])) if packed else np.empty((0, 2), np.int64)
