"""Bring records onto one row per series and hour, and join hourly tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliotide import SERIES, TS
from heliotide.functions.calendar import ZONE, add_hours, bound
from heliotide.operators.ordered import (
    KeySizes, attach, block_window, number_rows, over_rows, with_block_context,
)

KEY = (SERIES, TS)


def hour_of(ts: str = TS) -> Column:
    """Start of the hour; keeps the input type, also for zone-less times."""
    return F.window(ts, "1 hour").start


def hourly_mean(
    df: DataFrame, values: Sequence[str], keys: Sequence[str] = (SERIES,), ts: str = TS
) -> DataFrame:
    """Mean of each value per series and hour; hours without any value are left out.

    Partial means are built before the shuffle on ``(keys, hour)``.
    """
    hourly = df.groupBy(*keys, hour_of(ts).alias(TS)).agg(*[F.avg(v).alias(v) for v in values])
    return hourly.dropna(subset=list(values))


def select_region(df: DataFrame, code: int | str, column: str = "code_insee_region") -> DataFrame:
    """Rows of one region; codes are text."""
    return df.where(F.col(column) == str(code))


def between_times(df: DataFrame, start: str, end: str, ts: str = TS, zone: str = ZONE) -> DataFrame:
    """Closed time range (P2); for instants, bounds without offset are wall-clock times in ``zone``."""
    kind = df.schema[ts].dataType
    return df.where(F.col(ts).between(bound(start, kind, zone), bound(end, kind, zone)))


def clip_to(rows: DataFrame, reference: DataFrame, extra_hours: int = 0, sizes: KeySizes | None = None) -> DataFrame:
    """Rows inside ``[first, last + extra_hours]`` of the reference series (P8); ``sizes`` as in ``attach``."""
    bounds = reference.groupBy(SERIES).agg(
        F.min(TS).alias("_first"), add_hours(F.max(TS), extra_hours).alias("_last")
    )
    inside = attach(rows, bounds, how="inner", sizes=sizes).where(F.col(TS).between(F.col("_first"), F.col("_last")))
    return inside.select(*rows.columns)


def join_hourly(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Equi-join of two hourly tables on series and hour."""
    return left.join(right, list(KEY), how)


def index_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per series, how many hours only one of two tables has (Q7)."""
    a = left.select(*KEY, F.lit(1).alias("_a"))
    b = right.select(*KEY, F.lit(1).alias("_b"))
    return (
        a.join(b, list(KEY), "full_outer")
        .groupBy(SERIES)
        .agg(
            F.count_if(F.col("_b").isNull()).alias("only_left"),
            F.count_if(F.col("_a").isNull()).alias("only_right"),
            F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"),
        )
    )


def fill_hour_grid(df: DataFrame) -> DataFrame:
    """Add a row with missing values for every absent hour inside a series.

    Each row emits the hours up to the next one, so no grid table or join is
    needed.
    """
    values = [c for c in df.columns if c not in KEY]
    hour = F.expr("INTERVAL 1 HOUR")
    ahead = over_rows(df, lambda w: {"_next": F.lead(TS, 1).over(w)}, ahead=1)
    upto = F.coalesce(F.col("_next") - hour, F.col(TS))
    filled = ahead.withColumn("_hour", F.explode(F.sequence(F.col(TS), upto, hour)))
    own = F.col("_hour") == F.col(TS)
    return filled.select(
        SERIES, F.col("_hour").alias(TS), *[F.when(own, F.col(v)).alias(v) for v in values]
    )


def hourly_from_daily(df: DataFrame, day: str = "day") -> DataFrame:
    """Daily series -> hours, each taking the latest daily row at or before it.

    The last day gets its own 24 hours. A daily row is valid until the next
    one, so it is expanded in place instead of joined as-of.
    """
    values = [c for c in df.columns if c not in (SERIES, day)]
    ahead = over_rows(df, lambda w: {"_next": F.lead(day, 1).over(w)}, ahead=1, ts=day)
    start = F.col(day).cast("timestamp_ntz")
    end = F.coalesce(F.col("_next"), F.date_add(day, 1)).cast("timestamp_ntz")
    hour = F.expr("INTERVAL 1 HOUR")
    return ahead.select(
        SERIES, F.explode(F.sequence(start, end - hour, hour)).alias(TS), *values
    )


def forward_fill(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Replace missing values by the last known one of the series."""
    context = with_block_context(
        df,
        before_last={
            f"_{v}": F.max_by(v, F.when(F.col(v).isNotNull(), F.col(TS))) for v in values
        },
    )
    upto = block_window().rowsBetween(Window.unboundedPreceding, 0)
    filled = {
        v: F.coalesce(F.last(v, ignorenulls=True).over(upto), F.col(f"_{v}")) for v in values
    }
    return context.select(*[filled[c].alias(c) if c in filled else c for c in df.columns])


def interpolate(df: DataFrame, values: Sequence[str], limit: int = 3) -> DataFrame:
    """Linear interpolation by row, forward, at most ``limit`` rows per gap.

    A longer gap gets its first ``limit`` rows. After the last known value that
    value is repeated, again at most ``limit`` times; rows before the first
    known value stay missing. Missing means NULL.
    """
    numbered = number_rows(df, "_pos", keep_block=True)
    known = {
        v: F.when(F.col(v).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(v).alias("v")))
        for v in values
    }
    context = with_block_context(
        numbered,
        before_last={f"_prev_{v}": F.max_by(k, F.when(k.isNotNull(), F.col(TS))) for v, k in known.items()},
        after_first={f"_next_{v}": F.min_by(k, F.when(k.isNotNull(), F.col(TS))) for v, k in known.items()},
    )
    upto = block_window().rowsBetween(Window.unboundedPreceding, 0)
    onward = block_window().rowsBetween(0, Window.unboundedFollowing)
    sides = context.select(
        *df.columns,
        "_pos",
        *[
            F.coalesce(F.last(k, ignorenulls=True).over(upto), F.col(f"_prev_{v}")).alias(f"_prev_{v}")
            for v, k in known.items()
        ],
        *[
            F.coalesce(F.first(k, ignorenulls=True).over(onward), F.col(f"_next_{v}")).alias(f"_next_{v}")
            for v, k in known.items()
        ],
    )
    filled = {v: _between(v, limit) for v in values}
    return sides.select(*[filled[c].alias(c) if c in filled else c for c in df.columns])


def _between(value: str, limit: int) -> Column:
    before, after = F.col(f"_prev_{value}"), F.col(f"_next_{value}")
    step = F.col("_pos") - before["p"]
    slope = F.try_divide((after["v"] - before["v"]) * step, after["p"] - before["p"])
    line = F.coalesce(before["v"] + slope, before["v"])
    return F.coalesce(F.col(value), F.when(step <= limit, line))
