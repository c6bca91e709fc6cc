"""Secrets in texts, with weak candidates confirmed by their complementary parts.

Strong kinds (assignments, access identifiers, long hexadecimal runs) count
alone. Weak kinds (account names, mixed random-looking runs, endpoints) are no
secret by themselves; a credential has several parts, so a weak candidate is
reported only if a complementary part lies in its scope: an identifier or an
endpoint near a secret, or a secret near one of them.

Parts are found where a text is read. The linking is an interval join within
(document, text): for each part the nearest part of every role before and after
it decides whether the two intervals, widened by the scope, meet. Nearest parts
come from running windows, so the work is linear in the parts and no pairs are
made, however many parts a scope holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliotide.session import cut_lineage

SCOPE = 200

#: The patterns of the strong kinds, in the order in which spans at one place are listed.
ASSIGN = re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Weak kinds, after the strong ones in the order of listing.
IDENTIFIER = re.compile(r"""(?a:\b(?i:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,}))""")
#: Whole runs of any length; a run right behind '=' is a value, one right before '=' and more of them a name.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?a:https?://[^\s"'<>]{4,}|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?\b)""")

KINDS = ("assign", "access", "hex", "identifier", "run", "endpoint")
STRONG = KINDS[:3]
ROLE = {"assign": "secret", "access": "name", "hex": "secret", "identifier": "name", "run": "secret", "endpoint": "place"}
COMPLEMENTS = {"secret": ("name", "place"), "name": ("secret",), "place": ("secret",)}
_CUT = {KINDS.index("identifier"): IDENTIFIER, KINDS.index("endpoint"): ENDPOINT}
_PART = "struct<start:int,kind:int,end:int>"


def parts_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all parts of a text, in code points; weak ones only outside strong ones."""
    strong = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    strong += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    strong += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    weak = [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)]
    weak += [(m.start(), 4, m.end()) for m in RUN.finditer(text) if _mixed(m[0])]
    weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    strong.sort()
    if weak and strong:
        weak = _outside(text, sorted(weak), strong)
    return sorted(strong + weak)


def _mixed(run: str) -> bool:
    """Digits, capitals and small letters together: words and numbers are none."""
    return any(c.isdigit() for c in run) and any("a" <= c <= "z" for c in run) and any("A" <= c <= "Z" for c in run)


def _outside(text: str, weak: list[tuple[int, int, int]], strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The weak parts that overlap no strong one; both sorted by start.

    An identifier or endpoint that runs into a strong part ends before it, if what is left is still one.
    """
    out, k, reach = [], 0, -1
    for start, kind, end in weak:
        while k < len(strong) and strong[k][0] <= start:
            reach = max(reach, strong[k][2])
            k += 1
        if reach > start:
            continue
        if k == len(strong) or strong[k][0] >= end:
            out.append((start, kind, end))
        elif kind in _CUT and (left := _CUT[kind].match(text, start, strong[k][0])):
            out.append((start, kind, left.end()))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [[{"start": s, "kind": k, "end": e} for s, k, e in parts_of(text or "")] for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(found, kind)], names=["doc_id", "text_key", "parts"])


def found(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, base, linked`` for each row: strong parts, and weak parts whose complement lies within ``scope`` code points.

    Both are arrays of structs (start, kind number, end). Null texts count as
    empty. Rows with a null or repeated doc_id are told apart by their text.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    rows = cut_lineage(keyed.mapInArrow(_scan, f"doc_id bigint, text_key bigint, parts array<{_PART}>"))
    weak = F.exists("parts", lambda p: p["kind"] >= len(STRONG))
    parts = rows.where(weak & (F.size("parts") > 1)).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.explode("parts").alias("p"))
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("p.kind") + 1)
    parts = parts.withColumn("role", role)
    whole = Window.partitionBy("doc_id", "text_key").orderBy("p.start", "p.kind", "p.end")
    before, after = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(1, Window.unboundedFollowing)

    def near(other: str) -> Column:
        end = F.max(F.when(F.col("role") == other, F.col("p.end"))).over(before)
        start = F.min(F.when(F.col("role") == other, F.col("p.start"))).over(after)
        return F.coalesce(F.col("p.start") - end <= scope, F.lit(False)) | F.coalesce(start - F.col("p.end") <= scope, F.lit(False))

    met = parts.select("*", *[near(r).alias(f"near_{r}") for r in COMPLEMENTS])
    linked = F.lit(False)
    for own, others in COMPLEMENTS.items():
        for other in others:
            linked = linked | ((F.col("role") == own) & F.col(f"near_{other}"))
    confirmed = (
        met.where(linked & (F.col("p.kind") >= len(STRONG)))
        .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("p")).alias("linked"))
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "linked")
    )
    joined = rows.join(confirmed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select(
        "doc_id",
        F.filter("parts", lambda p: p["kind"] < len(STRONG)).alias("base"),
        F.coalesce("linked", F.array().cast(f"array<{_PART}>")).alias("linked"),
    )


def _listed(parts: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(parts), lambda p: F.concat_ws(":", F.element_at(kinds, p["kind"] + 1), p["start"].cast("string"), p["end"].cast("string"))), ","
    )


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked`` for each row of ``docs``."""
    count = lambda k: F.size(F.filter("base", lambda p: p["kind"] == k)).cast("bigint")
    return found(docs, scope).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("bigint").alias("n_linked"),
    )
