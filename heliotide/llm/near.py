"""Near duplicates: an exact n-gram Jaccard join with token-combination prefixes.

A document's set is its distinct word shingles. Documents with equal sets form a
class, and the join works on classes. Shingles are ordered by rarity, rare ones
first; two sets within the threshold share a *signature* drawn from the first
few of each. For rare shingles a signature is the shingle itself; for the class
of frequent ones it is a pair of shingles, and the prefix is extended by one for
it: of r single and f frequent shingles in a prefix, any ``r + f - 2`` may be
missing and one single shingle or one pair is still left.

Candidates with a common signature are not expanded into all pairs. First every
member is verified against four classes of its group, the first and last in two
orders; what is linked falls into components. Groups with several components do
so again with other centres, in an order of their own. Then only pairs of one group in
different components are left, and all of those are verified too, save those
that sizes or parities rule out. So no link between components is missed, and
links inside one change nothing.

The order comes from counters over hashed shingles of all documents. Their
number is fixed, so they can be broadcast at any size of input; any order gives
the same links, a coarser one only more candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliotide.llm.components import components
from heliotide.llm.words import mix, shingles, slices, split
from heliotide.llm.settle import settled

SHINGLE = 4
PERCENT = 85
COUNTER_BITS = 21
_BLOCKS = 32
#: A shingle is frequent if its counter exceeds the mean counter by this.
FREQUENT = 4096
_IS_FREQUENT = 255
STAR_ROWS = 256
MOST_BITS = 1 << 13
LONGS = 8
_LONGS = [f"l{i}" for i in range(LONGS)]
SLICE_BYTES = 1 << 20


def shingle_sets(data: np.ndarray, texts: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Per text its distinct shingle hashes, sorted; the whole sequence if it has fewer words, nothing without words."""
    words = split(data, texts, lower=True)
    every = shingles(words.hashes, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            out.append(shingles(words.hashes[a:b], b - a))
        else:
            out.append(every[:0])
    return out


def class_key(tokens: np.ndarray) -> int:
    """Hash of a set."""
    key = mix(mix(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens)))
    return int(key.view(np.int64)[0])


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two non-empty sorted sets reach the Jaccard threshold."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def parity_bits(tokens: np.ndarray) -> bytes:
    """Parity of the number of shingles per slot, for about as many slots as shingles (a power of two)."""
    width = min(MOST_BITS, max(64, 1 << max(len(tokens) - 1, 0).bit_length()))
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def parity_longs(tokens: np.ndarray) -> np.ndarray:
    """Parities over a fixed number of slots, as 64-bit numbers: coarser for large sets, but a join condition can use them."""
    odd = np.bincount((tokens & np.uint64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(n: int, bits: bytes, m: int, other: bytes, percent: int = PERCENT) -> bool:
    """False only if sizes or parities rule a link out: each differing slot needs a shingle that only one set has."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    x, y = np.frombuffer(bits, np.uint8), np.frombuffer(other, np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (n + m) * (100 - percent)


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _scan(size: int):
    """Rows ``doc_id, row_key, n, class_key`` and, at the end of a task, its counters in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTER_BITS, dtype=np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("class_key", pa.int64()), ("bits", pa.binary()), *[(c, pa.int64()) for c in _LONGS], ("block", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            for row, last, data, texts in slices(batch.column("text"), SLICE_BYTES):
                sets = shingle_sets(data, texts, size)
                keys = [class_key(s) if len(s) else None for s in sets]
                distinct = {k: s for k, s in zip(keys, sets) if k is not None}
                if distinct:
                    np.add.at(counters, _slots(np.concatenate(list(distinct.values()))), 1)
                n = last - row
                longs = np.array([parity_longs(s) for s in sets], dtype=np.int64).reshape(n, LONGS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, n), batch.column("row_key").slice(row, n), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.int64()), pa.array([parity_bits(s) for s in sets], pa.binary()), *[pa.array(longs[:, i]) for i in range(LONGS)], pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                    ],
                    schema=schema,
                )
        for block, part in enumerate(np.split(counters, _BLOCKS)):
            if part.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(1, pa.binary()), *[none] * LONGS, pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=schema)

    return run


def _ranks(mean: float, frequent: int):
    """Sum of a block's counters, as one byte each: a logarithm, or 255 for frequent shingles."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << COUNTER_BITS) // _BLOCKS, dtype=np.int64)
        for raw in table.column("counts").to_pylist():
            total += np.frombuffer(raw, np.uint32)
        rank = np.minimum(4 * np.log2(np.maximum(total, 1)), 254).astype(np.uint8)
        rank[total > mean + frequent] = _IS_FREQUENT
        return pa.table({"block": table.column("block").slice(0, 1), "ranks": pa.array([rank.tobytes()], pa.binary())})

    return run


def signatures(tokens: np.ndarray, ranks: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of one set. A set of one shingle links with equal sets only and has none."""
    n = len(tokens)
    if n < 2:
        return tokens[:0]
    rank = ranks[_slots(tokens)]
    order = np.lexsort((tokens, rank))
    missing = n - (percent * n + 99) // 100
    rare = int((rank != _IS_FREQUENT).sum())
    if rare > missing:
        return tokens[order[: missing + 1]]
    chosen = np.sort(tokens[order[rare : missing + 2]])
    i, j = np.triu_indices(len(chosen), 1)
    return np.concatenate([tokens[order[:rare]], mix(mix(chosen[i]) + chosen[j])])


def _sign(size: int, percent: int, ranks: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, texts in slices(batch.column("text"), SLICE_BYTES):
                distinct = {class_key(s): s for s in shingle_sets(data, texts, size) if len(s) > 1}
                found = [signatures(s, ranks.value, percent) for s in distinct.values()]
                if found:
                    count = [len(f) for f in found]
                    keys = np.repeat(np.fromiter(distinct, np.int64, len(distinct)), count)
                    sizes = np.repeat(np.array([len(s) for s in distinct.values()], np.int64), count)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(found).view(np.int64)), pa.array(keys), pa.array(sizes)], names=["sig", "class_key", "n"]
                    )

    return run


def _possible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(*values, percent) for values in zip(*(batch.column(c).to_pylist() for c in ("n", "bits", "m", "other")))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(size: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        owners = table.column("a").to_pylist()
        sets: dict[int, np.ndarray] = {}
        at = 0
        for row, last, data, texts in slices(table.column("text"), SLICE_BYTES):
            for s in shingle_sets(data, texts, size):
                sets[owners[at]] = s
                at += 1
        centre = table.column("b")[0].as_py()
        linked = [a for a, s in sets.items() if a != centre and similar(s, sets[centre], percent)]
        return pa.table({"a": pa.array(linked, pa.int64()), "b": pa.array([centre] * len(linked), pa.int64())})

    return run


def possible(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (``a, b`` class keys) without those that sizes or parity bits rule out."""
    known = classes.select("class_key", F.struct("n", "bits").alias("known"))
    both = pairs.join(known.select(F.col("class_key").alias("a"), F.col("known").alias("x")), "a").join(known.select(F.col("class_key").alias("b"), F.col("known").alias("y")), "b")
    return both.select("a", "b", "x.n", "x.bits", F.col("y.n").alias("m"), F.col("y.bits").alias("other")).mapInArrow(_possible(percent), "a bigint, b bigint")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b`` class keys) whose sets are similar enough.

    Each centre b meets its partners in groups of about ``STAR_ROWS``, so a
    centre with very many partners is spread over many tasks.
    """
    stars = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).alias("parts"))
    placed = pairs.join(stars, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    roles = placed.union(placed.select(F.col("b").alias("a"), "b", "part").distinct())
    one = classes.select(F.col("class_key").alias("a"), "row_key")
    texts = docs.select("row_key", "text").join(roles.join(one, "a"), "row_key").select("a", "b", "part", "text")
    return settled(texts.groupBy("b", "part").applyInArrow(_verify(size, percent), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest doc_id reachable over links, its own
    included; null ids never count, so it is null where a component has no id.
    Null texts and texts without words have an empty set, link with nothing and
    keep their own id. Rows that repeat a doc_id are judged by their own text.
    """
    return _labelled(*_grouped(docs, size, percent, frequent))


def without_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row with the smallest (doc_id, row key).

    Null ids come last. Rows without words all stay, and so do rows that are
    equal to the kept one in doc_id and text (``exact`` leaves one of them).
    """
    rows, classes, roots = _grouped(docs, size, percent, frequent)
    # Per class first, so that a class of very many rows is one row when it meets its component.
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    best = rows.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min(first).alias("first"))
    stay = best.join(roots, "class_key", "left").groupBy(F.coalesce("root", "class_key")).agg(F.min("first")["row_key"].alias("_stay"))
    stay = stay.select("_stay").union(rows.where("class_key IS NULL").select("row_key")).distinct()
    return docs.join(stay, _row_key(docs) == stay["_stay"], "left_semi")


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("bigint"), docs["text"].cast("string"))


def _grouped(docs: DataFrame, size: int, percent: int, frequent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (``doc_id, row_key, n, class_key, ...``), their classes, and ``class_key, root`` of the classes that are no root."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), _row_key(docs).alias("row_key"))
    scanned = settled(docs.mapInArrow(_scan(size), f"doc_id bigint, row_key bigint, n bigint, class_key bigint, bits binary, {', '.join(f'{c} bigint' for c in _LONGS)}, block int, counts binary"))
    rows = scanned.where("block IS NULL").drop("block", "counts")
    classes = settled(rows.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("bits", *_LONGS)]))
    mean = (classes.agg(F.sum("n")).first()[0] or 0) / (1 << COUNTER_BITS)
    blocks = scanned.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(_ranks(mean, frequent), "block int, ranks binary")
    table = np.zeros((_BLOCKS, (1 << COUNTER_BITS) // _BLOCKS), dtype=np.uint8)
    for r in blocks.collect():
        table[r["block"]] = np.frombuffer(r["ranks"], np.uint8)
    # One byte per counter, whatever the input.
    ranks = spark.sparkContext.broadcast(table.ravel())

    group = Window.partitionBy("sig")
    least, most = F.min("class_key").over(group), F.max("class_key").over(group)
    mixed = F.struct(F.xxhash64("class_key").alias("h"), "class_key")
    others = [F.min(mixed).over(group)["class_key"], F.max(mixed).over(group)["class_key"]]
    postings = docs.mapInArrow(_sign(size, percent, ranks), "sig bigint, class_key bigint, n bigint").select(
        "sig", "class_key", "n", least.alias("least"), most.alias("most"), F.array(least, most, *others).alias("centres")
    )
    postings = settled(postings.where("least <> most").drop("least", "most").distinct())
    stars = postings.select(F.col("class_key").alias("a"), F.explode("centres").alias("b")).where("a <> b").distinct()
    postings = postings.drop("centres")
    links = verified(docs, classes, settled(possible(classes, stars, percent)), size, percent)
    # Once more with other centres where components are left, so that few pairs remain.
    mixed = _mixed(postings, components(links))
    links = links.union(verified(docs, classes, settled(possible(classes, _stars_across(mixed), percent)), size, percent))
    mixed = _mixed(mixed.drop("root", "major"), components(links))
    links = links.union(verified(docs, classes, settled(_across(mixed, classes, percent)), size, percent))
    roots = components(links).select(F.col("a").alias("class_key"), "root")
    return rows, classes, roots


def _mixed(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """``sig, class_key, n, root, major`` of the signature groups with several components; ``major`` is the root of the commonest."""
    member = postings.join(roots.select(F.col("a").alias("class_key"), "root"), "class_key", "left")
    member = member.select("sig", "class_key", "n", F.coalesce("root", "class_key").alias("root"))
    counts = member.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("c"))
    most = counts.groupBy("sig").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    return settled(member.join(most.drop("roots"), "sig"))


def _stars_across(mixed: DataFrame) -> DataFrame:
    """Pairs of members with centres of their group in other components: two inside the commonest component, two outside.

    The order differs from group to group, so a member of many groups meets many centres.
    """
    one, order = F.struct("class_key", "root"), F.xxhash64("sig", "class_key")
    inside, outside = F.when(F.col("root") == F.col("major"), order), F.when(F.col("root") != F.col("major"), order)
    centres = mixed.groupBy("sig").agg(F.array(*[pick(one, o) for pick in (F.min_by, F.max_by) for o in (inside, outside)]).alias("centres"))
    met = mixed.join(centres, "sig").select("class_key", "root", F.explode("centres").alias("centre")).where("root <> centre.root")
    return met.select(F.col("class_key").alias("a"), F.col("centre.class_key").alias("b")).distinct()


def _across(mixed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of one signature group in different components that sizes and parities do not rule out.

    In each group one component is the commonest; only members outside it are
    paired with the others, so a group that is one component makes no rows.
    """
    mixed = settled(mixed.join(classes.select("class_key", *_LONGS), "class_key"))
    outside = mixed.where("root <> major").select(
        "sig", F.col("class_key").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), *[F.col(c).alias(f"x{c}") for c in _LONGS]
    )
    differing = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"x{c}"))) for c in _LONGS), F.lit(0))
    fits = (
        (F.col("rx") != F.col("root"))
        & (F.least("nx", "n") * 100 >= F.greatest("nx", "n") * percent)
        & (differing * (100 + percent) <= (F.col("nx") + F.col("n")) * (100 - percent))
    )
    pairs = outside.join(mixed, (outside["sig"] == mixed["sig"]) & fits)
    return pairs.select(F.greatest("x", "class_key").alias("a"), F.least("x", "class_key").alias("b")).distinct()


def _labelled(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    known = classes.join(roots, "class_key", "left").select("class_key", F.coalesce("root", "class_key").alias("root"), "least")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    label = known.join(least, "root").select("class_key", "component_id")
    # Copies of one class may be a third of all rows: spread the rows without words, let skew handling split the rest.
    single = rows.where("class_key IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("class_key IS NOT NULL").join(label, "class_key").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(single)
