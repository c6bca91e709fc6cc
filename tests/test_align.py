import numpy as np
import pandas as pd
import pytest
from conftest import ordered, per_series, same, to_spark
from pyspark.sql import functions as F

from heliotide.operators import align


def series(spark, values, name="a"):
    pdf = pd.DataFrame({"series_id": name, "ts": pd.date_range("2024-01-01", periods=len(values), freq="h"),
                        "y": pd.array(values, dtype="float64")})
    return pdf, to_spark(spark, pdf)


def test_interpolation_limit(spark):
    n = np.nan
    _, df = series(spark, [n, 1, n, n, n, n, 6, n, n, n, n])
    got = ordered(align.interpolate(df, ["y"], limit=3)).y
    same(got, [n, 1, 2, 3, 4, n, 6, 6, 6, 6, n])


def test_interpolation_across_blocks(spark, hourly, monkeypatch):
    pdf, df = hourly
    monkeypatch.setattr(align, "with_block_context", _small(align.with_block_context))
    monkeypatch.setattr(align, "number_rows", _small(align.number_rows))
    got = ordered(align.interpolate(df, ["y"], limit=3))
    want = per_series(pdf, lambda p: p.assign(y=p.y.interpolate("linear", limit=3)))
    same(got.y, want.y)
    filled = ordered(align.forward_fill(df, ["y"]))
    same(filled.y, per_series(pdf, lambda p: p.assign(y=p.y.ffill())).y)


def _small(fn):
    return lambda *a, **k: fn(*a, **{**k, "block_days": 1})


def test_clock_change_keeps_both_hours(spark):
    quarter = pd.date_range("2024-10-26T22:00", "2024-10-27T03:45", freq="15min")
    pdf = pd.DataFrame({"series_id": "a", "ts": quarter, "y": np.arange(len(quarter), dtype=float)})
    df = to_spark(spark, pdf).withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC"))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        assert align.hourly_mean(df, ["y"]).count() == 6
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hourly_mean_drops_empty_hours(spark):
    pdf = pd.DataFrame({"series_id": "a", "ts": pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:50", "2024-01-01 02:00", "2024-01-01 04:00"]),
                        "y": [1.0, 3.0, np.nan, 5.0]})
    got = ordered(align.hourly_mean(to_spark(spark, pdf), ["y"]))
    assert list(got.y) == [2.0, 5.0]


def test_grid_and_daily_expansion(spark):
    pdf = pd.DataFrame({"series_id": ["a", "a", "b"], "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 03:00", "2024-01-01 05:00"]), "y": [1.0, 2.0, 9.0]})
    got = ordered(align.fill_hour_grid(to_spark(spark, pdf)))
    same(got.y, [1, np.nan, np.nan, 2, 9])
    days = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-01-04", 2.0)], "series_id string, d string, v double")
    hours = ordered(align.hourly_from_daily(days.select("series_id", F.to_date("d").alias("day"), "v")))
    assert len(hours) == 96 and list(hours.v) == [1.0] * 72 + [2.0] * 24


def test_joins_clip_and_mismatch(spark):
    _, a = series(spark, [1.0, 2.0, 3.0])
    b = a.where(F.hour("ts") > 0).withColumnRenamed("y", "z")
    assert align.join_hourly(a, b).count() == 2
    assert align.join_hourly(a, b, "full_outer").count() == 3
    row = align.index_mismatch(a, b).first()
    assert (row.only_left, row.only_right, row.both) == (1, 0, 2)
    assert align.clip_to(a, b).count() == 2
    assert align.clip_to(a, a.limit(1).where("y = 1"), 1).count() == 2


def test_time_range_is_closed(spark):
    _, a = series(spark, [1.0, 2.0, 3.0])
    assert align.between_times(a, "2024-01-01 00:00:00", "2024-01-01 01:00:00").count() == 2
    with pytest.raises(Exception):
        align.between_times(a, "not a time", "x").count()
