"""Time expressions: parts, cyclic encoding, parsing, formatting."""

from __future__ import annotations

import math
from collections.abc import Mapping
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliotide import TS

#: Fixed value: where the production data live; calendar parts of instants are read off this clock by default.
ZONE = "Europe/Paris"

_PARTS = {
    "hour": F.hour,
    "weekday": F.weekday,  # Monday = 0
    "day": F.dayofmonth,
    "month": F.month,
    "year": F.year,
}


def wall_clock(df: DataFrame, ts: str = TS, zone: str = ZONE) -> Column:
    """Zone-less wall-clock time of ``ts``: an instant as seen in ``zone``, a zone-less time as it is.

    The session's time zone has no influence.
    """
    if not isinstance(df.schema[ts].dataType, T.TimestampType):
        return F.col(ts)
    zero = F.lit(0)
    seconds = (F.unix_micros(ts) / F.lit(1_000_000)).cast("decimal(18,6)")
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def part(name: str, ts: str | Column = TS) -> Column:
    """A calendar part of a zone-less time."""
    return _PARTS[name](ts)


def add_calendar(
    df: DataFrame, parts=("hour", "weekday", "month", "year"), ts: str = TS, zone: str = ZONE
) -> DataFrame:
    """Add one integer column per calendar part (F2), of the wall-clock time in ``zone`` where ``ts`` is an instant."""
    clock = wall_clock(df, ts, zone)
    return df.withColumns({name: part(name, clock) for name in parts})


def add_cyclic(df: DataFrame, periods: Mapping[str, int], ts: str = TS, zone: str = ZONE) -> DataFrame:
    """Add ``{part}_sin`` and ``{part}_cos`` for each part and period.

    ``day`` is the day of the month. Rounded half-even to 5 places. Instants
    are taken as wall-clock times in ``zone``.
    """
    columns = {}
    clock = wall_clock(df, ts, zone)
    for name, period in periods.items():
        angle = part(name, clock) * (2 * math.pi / period)
        columns[f"{name}_sin"] = F.bround(F.sin(angle), 5)
        columns[f"{name}_cos"] = F.bround(F.cos(angle), 5)
    return df.withColumns(columns)


def parse_instant(text: str) -> Column:
    """ISO text with offset -> instant; text that cannot be read -> NULL."""
    return F.try_to_timestamp(F.col(text))


def to_local(ts: str = TS, zone: str = ZONE, source: str = "UTC") -> Column:
    """Wall-clock time in ``zone`` of a zone-less time in ``source``."""
    return F.convert_timezone(F.lit(source), F.lit(zone), F.col(ts))


def add_hours(ts: str | Column, hours: int | Column) -> Column:
    """Physical hours added to a time."""
    start = F.col(ts) if isinstance(ts, str) else ts
    step = F.lit(hours) if isinstance(hours, int) else hours
    zero = F.lit(0)
    return start + F.make_dt_interval(zero, step.cast("int"), zero, zero.cast("decimal(18,6)"))


def horizon_of(label: str) -> Column:
    """``+7h`` -> 7."""
    return F.regexp_extract(F.col(label), r"^\+(\d+)h$", 1).try_cast("int")


def bound(text: str, kind: T.DataType, zone: str = ZONE) -> Column:
    """A time given as text, for comparison with a column of type ``kind``.

    For instants, text without offset is a wall-clock time in ``zone``.
    """
    if not isinstance(kind, T.TimestampType):
        return F.lit(text).cast(kind)
    time = datetime.fromisoformat(text)
    time = time if time.tzinfo else time.replace(tzinfo=ZoneInfo(zone))
    return F.timestamp_micros(F.lit(round((time - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))))


def as_text(ts: str | Column = TS) -> Column:
    """Publication format ``yyyy-MM-dd HH:mm:ss`` of a zone-less time (F7); see ``wall_clock`` for instants."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
