"""Exact order statistics without gathering a group in one task.

Values are counted first, so copies of one value cost one row. A sketch of
bounded size then cuts the distinct values of each group into slices of similar
length; slice totals give every slice its starting rank, and only rows of one
slice are sorted together. The sketch decides the cuts alone, never the
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 128
SALTS = 64
#: A value of more than this part of a column's rows is common.
COMMON = 1000
DEALS = 1 << 20


def _counted_slices(
    df: DataFrame, keys: Sequence[str], value: str, slices: int, weight: str | None = None, nulls: bool = False, few_keys: bool = False
) -> DataFrame:
    """``(keys, value, _c, _slice, _mid)``: distinct values, their counts and slices, and one value from the middle.

    With ``nulls`` missing values are counted too, as slice -1. Groups that are
    ``few_keys`` by construction (columns, months) get their cuts sent; otherwise
    the cuts are copied to the at most ``SALTS`` parts the values of a group are
    dealt to, so a group of very many values is no single task.
    """
    one = F.col(weight) if weight else F.lit(1)
    rows = df.select(*keys, F.col(value).alias("_v"), one.alias("_w"))
    counted = (rows if nulls else rows.where("_v IS NOT NULL")).groupBy(*keys, "_v").agg(F.sum("_w").alias("_c"))
    # one foldable expression instead of a hundred literals keeps plan analysis short
    probs = ",".join(str(i / slices) for i in range(1, slices))
    # naming _c keeps the branches equal, so the counts are built once
    present = "CASE WHEN _c > 0 THEN _v END"
    cuts = counted.groupBy(*keys).agg(
        F.expr(f"array_distinct(percentile_approx({present}, CAST(split('{probs}', ',') AS ARRAY<DOUBLE>), {10 * slices}))").alias("_cuts")
    )
    if few_keys or not keys:
        # without keys the cuts are one row
        placed = counted.join(F.broadcast(cuts), list(keys) or None)
    else:
        salted = counted.withColumn("_salt", F.when(F.col("_c") > 0, F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int")))
        parts = salted.select(*keys, "_salt").distinct().join(cuts, list(keys))
        placed = salted.join(parts, [*keys, "_salt"])
    place = F.when(F.col("_v").isNull(), -1).otherwise(_cuts_up_to(slices)) if nulls else _cuts_up_to(slices)
    return placed.select(*keys, "_v", "_c", place.alias("_slice"), F.get("_cuts", F.floor(F.size("_cuts") / 2).cast("int")).alias("_mid"))


def _cuts_up_to(slices: int) -> Column:
    """How many of the sorted ``_cuts`` are at most ``_v``, by binary search."""
    steps = [1 << i for i in reversed(range(slices.bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda found, step: F.when(
            F.get("_cuts", found + step - 1) <= F.col("_v"), found + step
        ).otherwise(found),
    )


def _slice_ranks(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, _slice, _size, _start, _n)``; at most ``SLICES`` rows per group."""
    return _starts(counted.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_size")), keys)


def _starts(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    group = Window.partitionBy(*keys)
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *keys, "_slice", "_size",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.sum("_size").over(group).alias("_n"),
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    slices: int = SLICES,
    few_keys: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles per group, missing values skipped.

    Only the slices that hold a wanted rank are sorted.
    """
    counted = _counted_slices(df, keys, value, slices, few_keys=few_keys)
    return _interpolated(counted, _slice_ranks(counted, keys), keys, probs, names)


def summaries(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], slices: int = SLICES,
    few_keys: bool = False,
) -> DataFrame:
    """Per group ``n, n_null, mean, std, min, max`` and exact quantiles, all from one count of the values.

    Deviations are taken from a value in the middle of the group, so the sample
    deviation keeps its digits where values are large and close together. A group
    without values has only ``n_null``.
    """
    counted = _counted_slices(df, keys, value, slices, nulls=True, few_keys=few_keys)
    off = F.col("_v") - F.col("_mid")
    parts = counted.groupBy(*keys, "_slice").agg(
        F.sum("_c").alias("_size"), F.sum(F.col("_c") * off).alias("_s1"), F.sum(F.col("_c") * off * off).alias("_s2"),
        F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.first("_mid").alias("_mid"),
    )
    known = F.col("_slice") >= 0
    totals = parts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(known, F.col("_size"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("_size"))), F.lit(0)).alias("n_null"),
        F.sum("_s1").alias("_s1"), F.sum("_s2").alias("_s2"), F.min("_least").alias("min"), F.max("_most").alias("max"),
        F.first("_mid", ignorenulls=True).alias("_mid"),
    )
    n = F.col("n")
    spread = F.greatest(F.col("_s2") - F.try_divide(F.col("_s1") * F.col("_s1"), n), F.lit(0.0))
    moments = totals.select(
        *keys, "n", "n_null", (F.col("_mid") + F.try_divide("_s1", n)).alias("mean"),
        F.when(n > 1, F.sqrt(spread / (n - 1))).alias("std"), "min", "max",
    )
    found = _interpolated(counted.where(known), _starts(parts.where(known), keys), keys, probs, names)
    return moments.join(found, list(keys), "left")


def _interpolated(
    counted: DataFrame, ranks: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    wanted = [_targets(p) for p in probs]
    hit = _any([
        (rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_size"))
        for lo, hi, _ in wanted for rank in (lo, hi)
    ])
    inside = Window.partitionBy(*keys, "_slice").orderBy("_v")
    upto = F.col("_start") + F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ranked = (
        counted.join(ranks.where(hit), [*keys, "_slice"])
        .withColumn("_last", upto)
        .withColumn("_first", F.col("_last") - F.col("_c"))
    )
    picks = []
    for i, (lo, hi, _) in enumerate(wanted):
        for side, rank in (("lo", lo), ("hi", hi)):
            at = (rank >= F.col("_first")) & (rank < F.col("_last"))
            picks.append(F.max(F.when(at, F.col("_v"))).alias(f"_{side}{i}"))
    found = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    return found.select(*keys, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share).alias(name)
        for i, ((_, _, share), name) in enumerate(zip(wanted, names))
    ])


def _targets(p: float) -> tuple[Column, Column, Column]:
    rank = (F.col("_n") - 1) * F.lit(float(p))
    low = F.floor(rank)
    return low, F.ceil(rank), rank - low


def _any(conditions: Sequence[Column]) -> Column:
    combined = conditions[0]
    for c in conditions[1:]:
        combined = combined | c
    return combined


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, slices: int = SLICES, weight: str | None = None, few_keys: bool = False
) -> DataFrame:
    """``(keys, value, avg_rank)`` per distinct value; ties share the mean rank.

    A row counts ``weight`` times.
    """
    return _ranked_values(df, keys, value, slices, weight, few_keys).select(*keys, value, "avg_rank")


def _ranked_values(
    df: DataFrame, keys: Sequence[str], value: str, slices: int = SLICES, weight: str | None = None, few_keys: bool = False
) -> DataFrame:
    """``(keys, value, avg_rank, _c, _n)``: also how often the value occurs, and all values of the group."""
    counted = _counted_slices(df, keys, value, slices, weight, few_keys=few_keys)
    ranks = _slice_ranks(counted, keys)
    inside = Window.partitionBy(*keys, "_slice").orderBy("_v")
    before = F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rank = F.col("_start") + F.coalesce(before, F.lit(0)) + (F.col("_c") + 1) / 2
    return counted.join(ranks, [*keys, "_slice"]).select(
        *keys, F.col("_v").alias(value), rank.alias("avg_rank"), "_c", "_n"
    )


def with_average_rank(rows: DataFrame, value: str, name: str, weight: str, of: DataFrame | None = None) -> DataFrame:
    """``rows`` with the average rank of ``value`` (no null) over all of them as ``name``; a row counts ``weight`` times.

    ``of`` are the same rows before other columns were added, where the values are counted.

    Values of more than a ``COMMON``-th of the weight, fewer than ``COMMON``, are
    sent to the rows. The others meet their rows by value, and rows that have
    their rank already are dealt evenly, so no value gathers its rows in one task.
    """
    ranks = _ranked_values(rows if of is None else of, [], value, weight=weight).withColumnRenamed(value, "_of")
    common = F.col("_c") * COMMON > F.col("_n")
    sent = F.broadcast(ranks.where(common).select("_of", F.col("avg_rank").alias("_sent")))
    # naming _c keeps _at a key: a plain -1 would be put into the condition, and rows dealt by value alone
    met = ranks.where(~common).select("_of", F.when(F.col("_c") > 0, -1).alias("_at"), F.col("avg_rank").alias("_met"))
    known = rows.join(sent, F.col(value) == sent["_of"], "left").drop("_of")
    dealt = known.withColumn("_deal", F.when(F.col("_sent").isNull(), -1).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(DEALS)).cast("int")))
    joined = dealt.join(met, (F.col(value) == F.col("_of")) & (F.col("_deal") == F.col("_at")), "left")
    return joined.select(*rows.columns, F.coalesce("_sent", "_met").alias(name))
