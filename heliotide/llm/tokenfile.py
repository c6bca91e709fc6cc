"""Token ids of a corpus in files, in ascending order of doc_id, and back.

A file row is a *segment*: whole documents one after another, their ids as
range-coded blocks (``rangecoder``) and a table of ids and lengths, both with
checksums. Segments are written by Spark's own writer, so a lost executor or a
task run twice leaves no half-written or doubled segment, and the folder may lie
on any file system Spark knows.

Documents are dealt to parts by bounds on doc_id that come from the doc_ids
alone; text is read and encoded once, and what is shuffled are 16-bit ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliotide.llm import bpe, rangecoder
from heliotide.llm.arrow import ids_and_texts
from heliotide.session import shared_dir

END_ID = 2
PART_ROWS = 10_000
#: Parts are counted on the driver and broadcast with their sizes, so their number is limited; parts then only grow.
MOST_PARTS = 1 << 16
SEGMENT_IDS = rangecoder.LANES * rangecoder.BLOCK
_SEGMENTS = "part int, first bigint, n_ids bigint, n_docs bigint, segment binary"
_TABLE = struct.Struct("<4sQII")
_MAGIC = b"HTSG"


def pack(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: head, table of doc_ids (null allowed) and lengths, code of all ids."""
    known = np.asarray(doc_ids.is_valid())
    plain = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    table = zlib.compress(known.astype(np.uint8).tobytes() + np.diff(plain, prepend=np.int64(0)).astype("<i8").tobytes() + lengths.astype("<i8").tobytes(), 1)
    return b"".join([_TABLE.pack(_MAGIC, len(lengths), len(table), zlib.crc32(table)), table, rangecoder.encode(ids)])


def unpack(segment: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a segment; ValueError where a checksum differs."""
    magic, n, size, crc = _TABLE.unpack_from(segment)
    table = segment[_TABLE.size : _TABLE.size + size]
    if magic != _MAGIC or zlib.crc32(table) != crc:
        raise ValueError("table of the segment is damaged")
    raw = zlib.decompress(table)
    known = np.frombuffer(raw, np.uint8, n).astype(bool)
    plain = np.cumsum(np.frombuffer(raw, "<i8", n, n), dtype=np.int64)
    return pa.array(plain, mask=~known), np.frombuffer(raw, "<i8", n, 9 * n), rangecoder.decode(segment[_TABLE.size + size :])


def _tokenised(bounds: np.ndarray, null_parts: int, end_id: int, folder: str | None):
    """``part, doc_id, tie, ids``: ids as 16-bit numbers; equal doc_ids may span several parts, in the order of ``tie``."""

    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for row, last, ids, offsets in bpe.encode(batch.column("text"), folder):
                if len(ids) and int(ids.max()) > rangecoder.MOST_ID:
                    raise ValueError(f"ids above {rangecoder.MOST_ID} do not fit this format")
                # Each text's ids and the closing one behind them.
                n = last - row
                raw, at = ids.astype("<u2").tobytes(), (2 * offsets).tolist()
                values = [raw[a:b] + end for a, b in zip(at[:-1], at[1:])]
                tie = np.array([zlib.crc32(v) for v in values], dtype=np.int64)
                own = doc_ids.slice(row, n)
                known = np.asarray(own.is_valid())
                plain = own.fill_null(0).to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(bounds, plain, "left"), np.searchsorted(bounds, plain, "right")
                part = np.where(known, null_parts + low + (tie * (high - low + 1) >> 32), tie * null_parts >> 32)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), own, pa.array(tie), pa.array(values, pa.binary())], names=["part", "doc_id", "tie", "ids"])

    return run


def _written(segment_ids: int):
    """Segments of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, docs, values, size = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal first, docs, values, size
            lengths = np.array([len(v) // 2 for v in values], np.int64)
            segment = pack(pa.array(docs, pa.int64()), lengths, np.frombuffer(b"".join(values), "<u2"))
            row = [pa.array([part], pa.int32()), *[pa.array([x], pa.int64()) for x in (first, size, len(docs))], pa.array([segment], pa.binary())]
            first, docs, values, size = first + size, [], [], 0
            return pa.RecordBatch.from_arrays(row, names=["part", "first", "n_ids", "n_docs", "segment"])

        for batch in batches:
            for p, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if docs and (p != part or size >= segment_ids):
                    yield flush()
                if p != part:
                    part, first = p, 0
                docs.append(doc_id)
                values.append(ids)
                size += len(ids) // 2
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, path: str, end_id: int = END_ID, folder: str | None = None, part_rows: int = PART_ROWS, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of ``docs`` (``doc_id, text``), each text closed by ``end_id``, into ``path``.

    Documents lie in ascending doc_id order, null ids first. Rows that repeat a
    doc_id all stay, ordered by checksum and ids. Null and empty texts are the
    closing id alone. An empty table gives files without rows. Ids must fit 16
    bits. Other columns are not read.
    """
    docs = ids_and_texts(docs)
    counts = docs.agg(F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    null_parts = min(MOST_PARTS, -(-counts["nulls"] // part_rows))
    parts = max(1, min(MOST_PARTS, -(-counts["n"] // part_rows)))
    bounds = np.empty(0, np.int64)
    if parts > 1:
        cuts = [i / parts for i in range(1, parts)]
        bounds = np.array(docs.agg(F.percentile_approx("doc_id", cuts, max(10_000, 20 * parts))).first()[0], np.int64)
    ids = docs.mapInArrow(_tokenised(bounds, null_parts, end_id, folder), "part int, doc_id bigint, tie bigint, ids binary")
    dealt = ids.repartitionById(null_parts + parts, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "tie", "ids")
    # Few segments per row group, so that a reader holds few at once.
    dealt.mapInArrow(_written(segment_ids), _SEGMENTS).write.option("compression", "none").option("parquet.block.row.count.limit", "4").parquet(path)


def _bases(segments: DataFrame) -> DataFrame:
    """``part, base``: ids of all parts before; there are at most ``2 * MOST_PARTS`` parts."""
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _unpacked(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, lengths, ids = unpack(batch.column("segment")[row].as_py())
                stops = np.cumsum(lengths)
                starts = stops - lengths
                n = len(lengths)
                if digest:
                    raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, stops[-1:]]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                part, first = batch.column("part")[row].as_py(), batch.column("first")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), doc_ids.cast(pa.int64()), pa.array(starts + first), pa.array(lengths.astype(np.int64)), last],
                    names=["part", "doc_id", "start", "n_tokens", "last"],
                )

    return run


def _read(spark: SparkSession, path: str, digest: bool, name: str, kind: str) -> DataFrame:
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    rows = segments.select("part", "first", "segment").mapInArrow(_unpacked(digest), f"part int, doc_id bigint, start bigint, n_tokens bigint, last {kind}")
    return rows.join(F.broadcast(_bases(segments)), "part").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", F.col("last").alias(name)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents in ``path``; ``start`` counts the ids of all before. Damage raises ValueError."""
    return _read(spark, path, False, "ids", "array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read``, with the CRC-32 of each document's ids as little-endian 32-bit numbers (``ids_crc32``) in place of the ids."""
    return _read(spark, path, True, "ids_crc32", "bigint")


def report(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` to a fresh folder of the shared one and gives the digests read back from there."""
    path = shared_dir(docs.sparkSession)
    write(docs, path, folder=folder)
    return digests(docs.sparkSession, path)
