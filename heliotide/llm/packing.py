"""Packs documents into sequences by shortest-pack-first over the length histogram.

A document's ids are cut into full sequences and one rest. Only the histogram of
the rests (at most ``limit - 1`` lengths) reaches the driver: lengths are placed
longest first, each into the pack with the least room that still takes it, and
what is kept is how often each packing pattern occurs. A pattern slot of length
l owns an interval of the ranks of all rests of length l, so documents find
their sequence by rank with a join on that small table.

Ranks come from counts per (length, bucket), so no task holds all rests of a
length, however many documents share it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliotide.llm import bpe
from heliotide.session import cut_lineage

LIMIT = 1024
BUCKET_ROWS = 5_000
END_ID = 0


def _tokenised(limit: int, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for row, last, ids, offsets in bpe.encode(batch.column("text"), folder):
                totals, checks = [], []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    own = np.concatenate([ids[a:b].astype("<u4", copy=False), end])
                    totals.append(len(own))
                    checks.append([zlib.crc32(own[k : k + limit].tobytes()) for k in range(0, len(own), limit)])
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(row, last - row), pa.array(totals, pa.int64()), pa.array(checks, pa.list_(pa.int64()))],
                    names=["doc_id", "doc_tokens", "crcs"],
                )

    return run


def tokenised(docs: DataFrame, limit: int = LIMIT, folder: str | None = None) -> DataFrame:
    """Per document the number of ids with the closing id 0, and the CRC-32 of each piece of ``limit`` ids."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _tokenised(limit, folder), "doc_id bigint, doc_tokens bigint, crcs array<bigint>"
    )


def patterns(histogram: Mapping[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences), by shortest-pack-first.

    ``histogram`` gives the number of items per length. A length goes into the
    packs with the least room that still take it, as often as it fits.
    """
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pack: tuple[int, ...], count: int, room: int) -> None:
        if count and room:
            rooms.setdefault(room, []).append((pack, count))
        elif count:
            done.append((pack, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                pack, count, room = (), left, limit
            else:
                pack, count = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            fit = room // length
            full = min(count, left // fit)
            put(pack + (length,) * fit, full, room - fit * length)
            left -= full * fit
            count -= full
            if left and count:
                # fewer than fit items are left, for one pack
                put(pack + (length,) * left, 1, room - left * length)
                left, count = 0, count - 1
            if pack:
                put(pack, count, room)
    return done + [p for packs in rooms.values() for p in packs]


def slots(packed: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, copies) for each length of each pattern."""
    out, used, sequence = [], {}, 0
    for pack, count in packed:
        offset = 0
        for length, run in groupby(pack):
            copies = len(list(run))
            rank = used.get(length, 0)
            out.append((length, rank, rank + count * copies, sequence, offset, copies))
            used[length] = rank + count * copies
            offset += length * copies
        sequence += count
    return out


def packed(docs: DataFrame, limit: int = LIMIT, folder: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text has the closing id only. Null doc_ids pass through;
    rows that repeat a doc_id are packed one by one. Full sequences come first
    in the numbering, then those made of rests. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = cut_lineage(tokenised(docs, limit, folder))
    buckets = max(1, -(-base.count() // bucket_rows))
    rows = base.select(
        "*",
        F.floor(F.col("doc_tokens") / limit).alias("_full"),
        (F.col("doc_tokens") % limit).alias("_rest"),
        F.pmod(F.xxhash64("doc_id", "crcs"), F.lit(buckets)).alias("_bucket"),
    )
    cells = rows.groupBy("_rest", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_full").alias("_m"))
    sizes = {r["_rest"]: (r["n"], r["m"]) for r in cells.groupBy("_rest").agg(F.sum("_n").alias("n"), F.sum("_m").alias("m")).collect()}
    full_before, start = [], 0
    for rest in sorted(sizes):
        full_before.append((rest, start))
        start += sizes[rest][1]
    table = slots(patterns({rest: n for rest, (n, _) in sizes.items() if rest}, limit))

    earlier = Window.partitionBy("_rest").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        "_rest", "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rank0"),
        F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_full0"),
    ).join(F.broadcast(spark.createDataFrame(full_before, "_rest bigint, _full_all bigint")), "_rest")
    inside = Window.partitionBy("_rest", "_bucket").orderBy("doc_id", "crcs")
    placed = rows.join(offsets, ["_rest", "_bucket"]).select(
        "doc_id", "doc_tokens", "crcs", "_full", "_rest",
        (F.col("_rank0") + F.row_number().over(inside) - 1).alias("_rank"),
        (F.col("_full_all") + F.col("_full0") + F.sum("_full").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_full")).alias("_first"),
    )
    # At most a few slots per length, whatever the number of documents.
    slot = F.broadcast(spark.createDataFrame(table, "_length bigint, _from bigint, _to bigint, _sequence bigint, _offset bigint, _copies bigint"))
    seated = placed.join(slot, (F.col("_rest") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")), "left")
    pieces = seated.select("*", F.posexplode("crcs").alias("_i", "ids_crc32"))
    whole = F.col("_i") < F.col("_full")
    nth = F.col("_rank") - F.col("_from")
    return pieces.select(
        "doc_id",
        (F.col("_i").cast("bigint") * limit).alias("start"),
        F.when(whole, F.lit(limit)).otherwise(F.col("_rest")).cast("bigint").alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.when(whole, F.col("_first") + F.col("_i")).otherwise(F.lit(start) + F.col("_sequence") + F.floor(nth / F.col("_copies"))).alias("sequence_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("_offset") + nth % F.col("_copies") * F.col("_rest")).cast("bigint").alias("offset"),
    )
