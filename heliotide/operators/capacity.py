"""Installed capacity from a registry of commissioning dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliotide import SERIES
from heliotide.operators.align import hourly_from_daily
from heliotide.operators.ordered import attach, running_sum


def daily_power(
    registry: DataFrame,
    technology: str,
    region: int | str | None = None,
    date_format: str | None = "dd/MM/yyyy",
) -> DataFrame:
    """Power per region and commissioning day for one technology (A2).

    Both filters are on grouping keys and run before the aggregate. Columns of
    ``registry``: ``region, day, technology, power``.
    """
    kept = registry.where(F.col("technology") == technology)
    if region is not None:
        kept = kept.where(F.col("region") == region)
    day = F.to_date("day", date_format) if date_format else F.col("day").cast("date")
    return kept.groupBy(F.col("region").cast("string").alias(SERIES), day.alias("day")).agg(
        F.sum("power").alias("power")
    )


def repair_old_dates(df: DataFrame, oldest: str = "1990-01-01", min_pct: float = 0.01) -> DataFrame:
    """Implausibly old commissioning days, per series (Q6).

    Their power as percent of the valid power decides: at or above ``min_pct``
    the rows move to the first valid day, below it they are dropped.
    """
    old = F.col("day") < F.lit(oldest).cast("date")
    share = df.groupBy(SERIES).agg(
        F.sum(F.when(old, F.col("power"))).alias("_old"),
        F.sum(F.when(~old, F.col("power"))).alias("_valid"),
        F.min(F.when(~old, F.col("day"))).alias("_first"),
    ).select(
        SERIES, "_first", F.try_divide(F.coalesce("_old", F.lit(0.0)) * 100, F.col("_valid")).alias("_pct")
    )
    joined = attach(df, share).where(~old | (F.col("_pct") >= min_pct))
    moved = F.when(old, F.col("_first")).otherwise(F.col("day"))
    return joined.select(*[moved.alias("day") if c == "day" else c for c in df.columns])


def cumulative_capacity(
    df: DataFrame, start: str | None = None, end: str | None = None, scale: float = 1000.0
) -> DataFrame:
    """Capacity in service per day, in units of ``scale``.

    Days before ``start`` count into the level but are not returned; ``end``
    is exclusive.
    """
    per_day = df.groupBy(SERIES, "day").agg(F.sum("power").alias("power"))
    level = running_sum(per_day, "power", "capacity", ts="day")
    return _cut(level, start, end).select(SERIES, "day", (F.col("capacity") / scale).alias("capacity"))


def weekly_capacity(df: DataFrame, start: str, end: str, scale: float = 1000.0) -> DataFrame:
    """Cumulative capacity, averaged over each calendar week and given to its days.

    Weeks end on Sunday. Days before ``start`` stay out of the mean; days from
    ``end`` on still enter it and are cut afterwards.
    """
    level = cumulative_capacity(df, start=start, scale=scale)
    week = Window.partitionBy(SERIES, F.trunc("day", "week"))
    smooth = level.withColumn("capacity", F.avg("capacity").over(week))
    return _cut(smooth, None, end)


def hourly_capacity(df: DataFrame, start: str, end: str, scale: float = 1000.0) -> DataFrame:
    """Weekly capacity carried to every hour."""
    return hourly_from_daily(weekly_capacity(df, start, end, scale))


def _cut(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        df = df.where(F.col("day") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("day") < F.lit(end).cast("date"))
    return df
