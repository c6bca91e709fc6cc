import datetime

import numpy as np
import pandas as pd
import pytest
from conftest import ordered, per_series, same, to_spark
from pyspark.sql import functions as F

from heliotide.operators import normalize, stats


def rolled(p, window, minimum, fill=True):
    q = p.y.rolling(window, min_periods=minimum).quantile(0.99)
    return (q.bfill() if fill else q).astype(np.float32)


def test_fast_and_plain_paths_match_pandas(hourly):
    pdf, df = hourly
    want = per_series(pdf, lambda p: p.assign(d=rolled(p, 50, 24)))
    for options in ({"chunk_rows": 60}, {"chunk_rows": 7}, {"fast": False}):
        got = ordered(normalize.rolling_quantile(df, "y", window=50, **options))
        same(got.denominator, want.d, 1e-6)
    strict = ordered(normalize.rolling_quantile(df, "y", window=20, min_values=20, back_fill=False))
    same(strict.denominator, per_series(pdf, lambda p: p.assign(d=rolled(p, 20, 20, False))).d, 1e-6)


def test_minimum_count(spark):
    for n, known in ((23, 0), (24, 24)):
        pdf = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "y": np.arange(n, dtype=float)})
        got = normalize.rolling_quantile(to_spark(spark, pdf), "y").where("denominator IS NOT NULL")
        assert got.count() == known


def test_normaliser_round_trip_and_unseen_rows(spark):
    n = 120
    pdf = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="h"),
                        "y": 5 + np.random.default_rng(1).random(n), "x": np.arange(n, dtype=float), "c": 3.0})
    df = to_spark(spark, pdf)
    fit = df.where(F.col("x") < 100)
    model = normalize.SeriesNormaliser(["x", "c", "absent"], "y", window=48).fit(fit)
    out = ordered(model.transform(df))
    want = rolled(pdf[:100], 48, 24).to_numpy()
    denominators = np.concatenate([want, np.repeat(want[-1], 20)])
    same(out.y, pdf.y / denominators, 1e-6)
    same(out.x, pdf.x / 99)
    same(out.c, np.zeros(n))
    back = ordered(model.inverse_transform_y(model.transform_y(df, "y"), "y"))
    same(back.y, pdf.y)


def test_zero_denominator_gives_null(spark):
    pdf = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=30, freq="h"), "y": np.zeros(30)})
    df = to_spark(spark, pdf)
    model = normalize.SeriesNormaliser([], "y", window=24).fit(df)
    assert model.transform_y(df, "y").where("y IS NOT NULL").count() == 0


def test_recent_quantile(spark):
    pdf = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=200, freq="h"), "y": np.arange(200.0)})
    got = normalize.recent_quantile(to_spark(spark, pdf), "y", days=4).first()
    assert abs(got.p99_value - pdf.y[-96:].quantile(0.99)) < 1e-9


@pytest.mark.parametrize("fast", [True, False])
def test_rolling_quantile_beyond_the_times_of_pandas(spark, fast):
    """Hours from 2261 to 2263, that is over the end of pandas' nanoseconds."""
    first = datetime.datetime(2262, 1, 1)
    y = np.random.default_rng(4).normal(size=6000)
    rows = [("a", first + datetime.timedelta(hours=i), float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    got = normalize.rolling_quantile(df, "y", window=48, chunk_rows=1000, fast=fast)
    got = got.orderBy("ts").select("denominator", F.col("ts").cast("string")).collect()
    want = pd.Series(y).rolling(48, min_periods=24).quantile(0.99).bfill().astype("float32")
    same([r[0] for r in got], want, 1e-6)
    assert [r[1] for r in got[:: len(got) - 1]] == [str(rows[0][1]), str(rows[-1][1])]


def test_lag_sums_beyond_the_times_of_pandas(spark):
    first = datetime.datetime(2262, 4, 1)
    rows = [("a", first + datetime.timedelta(hours=i), float(i % 7)) for i in range(1000)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    acf = stats.autocorrelation(df, "y", 7).orderBy("lag").collect()
    assert [r["lag"] for r in acf] == list(range(8)) and acf[0]["acf"] == 1.0 and acf[7]["acf"] > 0.98
