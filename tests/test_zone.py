"""The session's time zone must not decide any result."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from heliotide.functions import calendar
from heliotide.operators import align, features, publish, stats

#: Around both clock changes of a year in Paris, and around New Year.
STARTS = (datetime(2024, 3, 30, 20), datetime(2024, 10, 26, 20), datetime(2023, 12, 31, 20))


@pytest.fixture()
def instants(spark):
    rows = [
        (f"s{i}", (start.replace(tzinfo=timezone.utc) + timedelta(hours=h)), float(h % 24))
        for i, start in enumerate(STARTS) for h in range(60)
    ]
    return spark.createDataFrame(rows, "series_id string, ts timestamp, y double")


def in_zone(spark, zone, build):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = build()
        keep = [F.unix_micros(c).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes]
        return sorted(df.select(keep).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("build", [
    lambda df: calendar.add_calendar(df, ("hour", "weekday", "day", "month", "year")),
    lambda df: calendar.add_cyclic(df, {"month": 12, "hour": 24}),
    lambda df: features.add_time_features(df),
    lambda df: align.between_times(df, "2024-03-31 01:00:00", "2024-10-27 03:00:00"),
    lambda df: stats.decompose_additive(df, "y"),
    lambda df: publish.with_text_times(df, ["ts"]),
    lambda df: align.hourly_mean(df, ["y"]),
], ids=["calendar", "cyclic", "time features", "range", "decomposition", "texts", "hourly"])
def test_same_rows_in_two_session_zones(spark, instants, build):
    utc = in_zone(spark, "UTC", lambda: build(instants))
    assert utc and utc == in_zone(spark, "America/New_York", lambda: build(instants))


def test_parts_follow_the_paris_clock(spark, instants):
    got = calendar.add_calendar(instants, ("hour", "day")).select(F.unix_micros("ts").alias("t"), "hour", "day").collect()
    at = {r["t"]: (r["hour"], r["day"]) for r in got}
    micros = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000
    assert at[micros(2024, 3, 31, 0)] == (1, 31) and at[micros(2024, 3, 31, 1)] == (3, 31)
    assert at[micros(2024, 10, 27, 0)] == (2, 27) and at[micros(2024, 10, 27, 1)] == (2, 27)
    assert at[micros(2023, 12, 31, 23)] == (0, 1)


def test_range_bounds_are_paris_times(spark, instants):
    got = align.between_times(instants, "2024-03-31 01:00:00", "2024-03-31 03:00:00").select(F.unix_micros("ts")).collect()
    assert len(got) == 2
    offset = align.between_times(instants, "2024-03-31T01:00:00+00:00", "2024-03-31T01:00:00+00:00")
    assert offset.count() == 1
