"""Row-ordered computation that never puts a whole series into one task.

A plain ``Window.partitionBy(series)`` sorts each series in a single task, so
one long series decides the run time. Two building blocks avoid that:

* *Blocks* split the time axis at fixed days. What a row needs from other
  blocks (row offset, running total, last known value) is computed on one
  summary row per block, then joined back on ``(series, block)``.
* *Chunks* split a series by row position. Each chunk also gets copies of the
  ``back`` rows before and ``ahead`` rows after it, which makes every bounded
  row frame exact; the copies are dropped afterwards.

With unique hourly ``ts`` a block holds at most ``24 * block_days`` rows and a
chunk at most ``chunk_rows + back + ahead``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliotide import SERIES, TS

BLOCK = "_block"
BLOCK_DAYS = 128
CHUNK_ROWS = 4096
#: Per-key tables up to this size are sent to the rows.
BROADCAST_BYTES = 32 << 20
#: A key with more rows is spread; a task takes about so many.
HOT_ROWS = 10_000_000
MOST_HOT = 10_000


def _block_of(df: DataFrame, ts: str, block_days: int) -> Column:
    # Monotone in ts: physical days for instants, calendar days otherwise.
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        day = F.unix_seconds(ts) / 86400
    else:
        day = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01"))
    # Declared non-null: otherwise the join below filters one of its two branches on
    # the block and Spark no longer sees that both read the same upstream exchange.
    return F.coalesce(F.floor(day / block_days), F.lit(0))


def with_block(df: DataFrame, ts: str = TS, block_days: int = BLOCK_DAYS) -> DataFrame:
    """``_block``, the number of the row's span of days, unless it is there already."""
    return df if BLOCK in df.columns else df.withColumn(BLOCK, _block_of(df, ts, block_days))


def with_block_context(
    df: DataFrame,
    before_sum: Mapping[str, Column] | None = None,
    before_last: Mapping[str, Column] | None = None,
    after_first: Mapping[str, Column] | None = None,
    total_sum: Mapping[str, Column] | None = None,
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Add ``_block`` and, per row, what the other blocks of its series hold.

    Each mapping gives output name -> aggregate over one block. ``before_sum``
    adds up the blocks before, ``before_last`` takes the nearest non-null one
    before, ``after_first`` the nearest non-null one after, ``total_sum`` adds
    up all blocks. A frame that already has ``_block`` keeps it, so steps on
    the same blocks share one shuffle.
    """
    groups = [before_sum or {}, before_last or {}, after_first or {}, total_sum or {}]
    blocked = with_block(df, ts, block_days)
    blocks = blocked.groupBy(*keys, BLOCK).agg(
        *[agg.alias(name) for group in groups for name, agg in group.items()]
    )
    series = Window.partitionBy(*keys)
    before = series.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    after = series.orderBy(BLOCK).rowsBetween(1, Window.unboundedFollowing)
    sums, lasts, firsts, totals = groups
    context = blocks.select(
        *keys,
        BLOCK,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums],
        *[F.last(n, ignorenulls=True).over(before).alias(n) for n in lasts],
        *[F.first(n, ignorenulls=True).over(after).alias(n) for n in firsts],
        *[F.sum(n).over(series).alias(n) for n in totals],
    )
    return blocked.join(context, [*keys, BLOCK])


def block_window(keys: Sequence[str] = (SERIES,), ts: str = TS) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(ts)


def number_rows(
    df: DataFrame,
    name: str = "pos",
    total: str | None = None,
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    block_days: int = BLOCK_DAYS,
    keep_block: bool = False,
) -> DataFrame:
    """0-based position of each row in its series, and its length as ``total``."""
    context = with_block_context(
        df,
        before_sum={"_offset": F.count(F.lit(1))},
        total_sum={total: F.count(F.lit(1))} if total else None,
        keys=keys,
        ts=ts,
        block_days=block_days,
    )
    inside = F.row_number().over(block_window(keys, ts))
    return context.select(
        *df.columns,
        (F.col("_offset") + inside - 1).alias(name),
        *([total] if total else []),
        *([BLOCK] if keep_block else []),
    )


def running_sum(
    df: DataFrame,
    value: str,
    name: str,
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Cumulative sum from the start of the series up to and including the row."""
    context = with_block_context(
        df, before_sum={"_base": F.sum(value)}, keys=keys, ts=ts, block_days=block_days
    )
    upto = block_window(keys, ts).rowsBetween(Window.unboundedPreceding, 0)
    return context.select(*df.columns, (F.col("_base") + F.sum(value).over(upto)).alias(name))


def spread_chunks(
    numbered: DataFrame,
    back: int = 0,
    ahead: int = 0,
    chunk_rows: int = CHUNK_ROWS,
    pos: str = "pos",
) -> DataFrame:
    """Give each row its ``_chunk`` and copy it to the chunks whose frames reach it."""
    p = F.col(pos)
    first = F.greatest(F.floor((p - ahead) / chunk_rows), F.lit(0).cast("bigint"))
    last = F.floor((p + back) / chunk_rows)
    return numbered.withColumn("_chunk", F.explode(F.sequence(first, last)))


def in_own_chunk(chunk_rows: int = CHUNK_ROWS, pos: str = "pos") -> Column:
    return F.floor(F.col(pos) / chunk_rows) == F.col("_chunk")


def over_rows(
    df: DataFrame,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    back: int = 0,
    ahead: int = 0,
    keep: Sequence[str] = (),
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    chunk_rows: int = CHUNK_ROWS,
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Add window columns whose frames reach ``back`` rows back and ``ahead`` on.

    ``build`` gets the window (ordered by position) and returns name ->
    expression; the expression may also use ``pos`` and, when it is in
    ``keep``, the series length ``n_rows``. ``keep`` lists which of the two
    stay in the result.
    """
    taken = {"pos", "n_rows", "_chunk"} & set(df.columns)
    if taken:
        raise ValueError(f"rename these columns first: {sorted(taken)}")
    total = "n_rows" if "n_rows" in keep else None
    numbered = number_rows(df, "pos", total, keys, ts, block_days)
    spread = spread_chunks(numbered, back, ahead, chunk_rows)
    window = Window.partitionBy(*keys, "_chunk").orderBy("pos")
    columns = build(window)
    passed = [c for c in df.columns if c not in columns]
    wide = spread.select(
        *passed, "pos", "_chunk", *([total] if total else []),
        *[col.alias(name) for name, col in columns.items()],
    )
    ordered = [*df.columns, *[c for c in columns if c not in df.columns]]
    return wide.where(in_own_chunk(chunk_rows)).select(*ordered, *keep)


@dataclass(frozen=True)
class KeySizes:
    """How many keys a table has and its hot ones, as (rows, key values); measured once, used by many joins."""

    keys: tuple[str, ...]
    n_keys: int
    hot: tuple[tuple, ...] = ()


def key_sizes(df: DataFrame, keys: Sequence[str] = (SERIES,), hot_rows: int = HOT_ROWS) -> KeySizes:
    """Counts the keys of ``df`` and finds those with more than ``hot_rows`` rows, at most ``MOST_HOT``.

    One job that reads the key columns only. A pipeline that attaches several
    tables to the same rows calls it once and passes the result on.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = F.when(F.col("_rows") > hot_rows, F.struct("_rows", *keys))
    found = counts.agg(
        F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list(hot), asc=False), 1, MOST_HOT).alias("hot")
    ).first()
    return KeySizes(tuple(keys), found["n"], tuple(tuple(h) for h in found["hot"]))


def attach(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str] = (SERIES,),
    how: str = "left",
    sizes: KeySizes | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join one-row-per-key ``stats`` to ``rows``; runs nothing.

    Without ``sizes`` it is a plain join, and adaptive execution decides when the
    statistics are there: small ones are sent to the rows, and of large ones the
    part of a key that owns too many rows is read by several tasks.

    With the ``sizes`` of the table that ``stats`` was grouped from, the rows need
    not move: up to ``broadcast_bytes`` the statistics are broadcast, beyond that
    the rows are shuffled with only the hot keys spread. The result is the same
    all three ways.
    """
    if sizes is None:
        return rows.join(stats, list(keys), how)
    if sizes.keys != tuple(keys):
        raise ValueError(f"sizes are of {sizes.keys}, not of {tuple(keys)}")
    if sizes.n_keys * sum(_width(f.dataType) for f in stats.schema.fields) <= broadcast_bytes:
        return rows.join(F.broadcast(stats), list(keys), how)
    return attach_spread(rows, stats, sizes, how)


def _width(kind: T.DataType) -> int:
    """Bytes of a value in memory, roughly; texts, maps and arrays count as a kilobyte."""
    return 16 if isinstance(kind, (T.NumericType, T.DatetimeType, T.BooleanType)) else 1024


def attach_spread(
    rows: DataFrame, stats: DataFrame, sizes: KeySizes, how: str = "left", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join one-row-per-key ``stats`` to ``rows`` with the hot keys spread over several join partitions.

    A hot key gets one copy of its statistics per ``hot_rows`` rows, and its rows
    are dealt to the copies by their time, or by their values where they have
    none. All other keys keep one copy. The list of hot keys is bounded.
    """
    keys = list(sizes.keys)
    if not sizes.hot:
        return rows.join(stats, keys, how)
    spread = [TS] if TS in rows.columns else [
        f.name for f in rows.schema.fields
        if f.name not in keys and not isinstance(f.dataType, (T.MapType, T.ArrayType, T.VariantType))
    ] or keys
    n = F.coalesce("_copies", F.lit(1))
    dealt = rows.join(_hot_copies(rows, sizes, hot_rows), keys, "left")
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(*spread), n).cast("int")).drop("_copies")
    return dealt.join(copied_stats(stats, sizes, hot_rows), [*keys, "_salt"], how).drop("_salt")


def copied_stats(stats: DataFrame, sizes: KeySizes, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``stats`` with ``_salt``: a hot key once per ``hot_rows`` of its rows, every other key once."""
    n = F.coalesce("_copies", F.lit(1))
    counted = stats.join(_hot_copies(stats, sizes, hot_rows), list(sizes.keys), "left")
    return counted.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_copies")


def _hot_copies(df: DataFrame, sizes: KeySizes, hot_rows: int) -> DataFrame:
    kinds = T.StructType([T.StructField("_copies", T.IntegerType()), *[df.schema[k] for k in sizes.keys]])
    copies = [(-(-h[0] // hot_rows), *h[1:]) for h in sizes.hot]
    return F.broadcast(df.sparkSession.createDataFrame(copies, kinds))


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the highest ``order`` per key, by a partial aggregate.

    Copies of one key are reduced before the shuffle, so a key with very many
    versions costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)
