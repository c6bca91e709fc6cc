"""Exact duplicates by skew-safe combining, in DataFrame functions only.

Equal texts are those that agree after every white-space character is deleted.
They are combined in three stages, and each stage compares the whole normalised
text (it is part of the grouping key), never only its digest:

1. each task combines the copies it reads (the partial aggregate),
2. copies meet per (digest, salt), so no task gets all copies of one text,
3. the winners of the salts, at most one per salt and text, are combined.

One small row per text then tells every document its fate. Texts with at least
a thousandth of all documents number a thousand at most, so that side of the
join is broadcast; the others are joined by a shuffle in which no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliotide.llm.settle import settled

WHITE = (" ", "\t", "\n", "\x0b", "\f", "\r")
HOT_SHARE = 1000
_SHIFT = 10**20
_TOP = 2**63

Digest = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    """The text without ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in WHITE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def whole(sha: Column) -> Column:
    return sha


def _preference(doc_id: Column, length: Column) -> Column:
    """One number whose maximum is the longest text, then the smallest doc_id; a null id comes last.

    A fixed-width number keeps the aggregate a hash aggregate.
    """
    rank = F.lit(str(_TOP)).cast("decimal(20,0)") - doc_id.cast("decimal(19,0)")
    rank = F.coalesce(rank, F.lit(0)).cast("decimal(20,0)")
    return (length.cast("decimal(10,0)") * F.lit(str(_SHIFT)).cast("decimal(21,0)") + rank).cast("decimal(38,0)")


def _preferred_id(preference: Column) -> Column:
    rank = (preference % F.lit(str(_SHIFT)).cast("decimal(21,0)")).cast("decimal(20,0)")
    return F.when(rank > 0, (F.lit(str(_TOP)).cast("decimal(20,0)") - rank).cast("bigint"))


def _keyed(docs: DataFrame, digest: Digest, *more: Column) -> DataFrame:
    content = normalised(F.col("text"))
    sha = F.sha2(content, 256)
    best = _preference(F.col("doc_id"), F.char_length(F.coalesce(F.col("text"), F.lit(""))))
    return docs.select(digest(sha).alias("_digest"), sha.alias("_sha"), content.alias("_content"), best.alias("_best"), *more)


def salted(docs: DataFrame, digest: Digest = whole, salts: int | None = None) -> DataFrame:
    """One row per distinct normalised text and salt: ``_digest, _salt, _content, _n, _best``.

    The salt is that of the task, so each task sends one row per distinct text.
    It may differ between attempts; the final combining does not depend on it.
    """
    salts = salts or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.spark_partition_id(), F.lit(salts)).cast("int")
    rows = _keyed(docs, digest, salt.alias("_salt"))
    return rows.groupBy("_digest", "_salt", "_content").agg(F.count(F.lit(1)).alias("_n"), F.max("_best").alias("_best"))


def combined(docs: DataFrame, digest: Digest = whole, salts: int | None = None) -> DataFrame:
    """One row per distinct normalised text: ``_digest, _content, _n, _best``."""
    return salted(docs, digest, salts).groupBy("_digest", "_content").agg(F.sum("_n").alias("_n"), F.max("_best").alias("_best"))


def fates(docs: DataFrame, carry: list[str], digest: Digest = whole, salts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``row`` (struct of the columns ``carry``), ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``kept`` marks the row with the most code points in its original text, then
    the smallest doc_id. Rows that repeat the winner's doc_id and length are one
    document listed again and share its verdict. Null text is empty; a row with
    a null doc_id loses ties, and ``keep_id`` is null where it wins. An empty
    table gives an empty result. ``digest`` may shorten the SHA-256 digest;
    different texts under one digest are told apart by their content.
    """
    groups = combined(docs, digest, salts)
    winners = settled(groups.select("_digest", "_n", "_best"))
    clash = not winners.groupBy("_digest").count().where("count > 1").isEmpty()
    key = ["_digest", "_content"] if clash else ["_digest"]
    winners = groups.select(*key, "_n", "_best") if clash else winners
    total = winners.agg(F.sum("_n")).first()[0] or 0
    is_hot = F.col("_n") * HOT_SHARE >= F.lit(total)
    side = [F.col(k).alias(f"{k}_w") for k in key]
    rows = _keyed(docs, digest, F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")).select(*key, "_sha", F.col("_best").alias("_own"), "row")

    hot = winners.where(is_hot).select(*side, F.struct("_n", "_best").alias("_hot"))
    near = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"{k}_w") for k in key], "left").drop(*[f"{k}_w" for k in key])
    # A row that is served already gets a key of its own: a text with a space is nobody's normalised text.
    alone = F.sha2(F.concat(F.lit("served "), F.xxhash64("_own").cast("string")), 256)
    cold = winners.where(~is_hot).select(*side, F.struct("_n", "_best").alias("_cold"))
    joined = near.withColumn("_digest", F.when(F.col("_hot").isNull(), F.col("_digest")).otherwise(alone)).join(
        cold, [F.col(k) == F.col(f"{k}_w") for k in key], "left"
    )
    fate = F.coalesce("_hot", "_cold")
    return joined.select(
        "row",
        _preferred_id(fate["_best"]).alias("keep_id"),
        fate["_n"].alias("group_size"),
        (F.col("_own") == fate["_best"]).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def report(docs: DataFrame, digest: Digest = whole, salts: int | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``."""
    return fates(docs, ["doc_id"], digest, salts).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def without_copies(docs: DataFrame, digest: Digest = whole) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows of one document, one."""
    kept = fates(docs, docs.columns, digest).where("kept")
    one = Window.partitionBy("text_sha256").orderBy("keep_id")
    return kept.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select("row.*")
