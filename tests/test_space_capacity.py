import numpy as np
import pandas as pd
from conftest import ordered, same, to_spark
from pyspark.sql import functions as F

from heliotide.operators import capacity, spatial


def test_dispersion(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame([(t, p, rng.normal()) for t in pd.date_range("2024-01-01", periods=5, freq="h") for p in range(14)], columns=["ts", "point_id", "v"])
    got = ordered(spatial.central_and_dispersion(to_spark(spark, pdf), ["v"], 13), "ts")
    outer = pdf[pdf.point_id != 13].groupby("ts").v
    same(got.v, pdf[pdf.point_id == 13].v)
    same(got.v_delta_minmax, (outer.max() - outer.min()).round(4))
    same(got.v_std, outer.std().round(4))
    lost = spatial.central_and_dispersion(to_spark(spark, pdf[pdf.point_id < 13]), ["v"], 13)
    assert lost.where("v IS NULL").count() == 5
    central, others = spatial.split_central(to_spark(spark, pdf), 13)
    assert (central.count(), others.count()) == (5, 65)


def test_centres(spark):
    pdf = pd.DataFrame({"dept": ["1", "1", "2"], "lat": [1.0, 3.0, 10.0], "lon": [0.0, 4.0, 2.0], "w": [1.0, 3.0, 4.0]})
    got = spatial.weighted_centres(to_spark(spark, pdf), "dept", "w").toPandas()
    total = got[got.overall].iloc[0]
    same([total.lat, total.lon, total.weight], [(1 + 9 + 40) / 8, (12 + 8) / 8, 8])
    same(got[got.dept == "1"][["lat", "lon"]].iloc[0], [2.5, 3.0])


def registry(spark):
    rows = [(76, "01/06/1970", "Solaire", 1.0), (76, "02/01/2023", "Solaire", 2000.0), (76, "02/01/2023", "Solaire", 500.0),
            (76, "05/01/2023", "Solaire", 1000.0), (76, "10/01/2023", "Solaire", 4000.0), (76, "10/01/2023", "Eolien", 9.0), (11, "10/01/2023", "Solaire", 9.0)]
    return spark.createDataFrame(rows, "region int, day string, technology string, power double")


def test_capacity_chain(spark):
    daily = capacity.daily_power(registry(spark), "Solaire", 76)
    assert ordered(daily, "day").power.tolist() == [1.0, 2500.0, 1000.0, 4000.0]
    kept = capacity.repair_old_dates(daily)
    assert ordered(kept, "day").day.astype(str).tolist()[:2] == ["2023-01-02", "2023-01-02"]
    assert capacity.repair_old_dates(daily, min_pct=50).count() == 3
    level = ordered(capacity.cumulative_capacity(daily, "2023-01-03", "2023-01-10"), "day")
    assert level.capacity.tolist() == [3.501]
    weekly = ordered(capacity.weekly_capacity(daily, "2023-01-01", "2023-02-01"), "day")
    same(weekly.capacity, [3.001, 3.001, 7.501])
    hourly = ordered(capacity.hourly_capacity(daily, "2023-01-01", "2023-02-01"))
    assert len(hourly) == 9 * 24 and hourly.capacity.iloc[-24] == 7.501


def test_filters_reach_the_rows_before_grouping(spark, tmp_path):
    registry(spark).write.parquet(str(tmp_path / "r"))
    plan = capacity.daily_power(spark.read.parquet(str(tmp_path / "r")), "Solaire", 76)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(technology,Solaire)" in plan and "EqualTo(region,76)" in plan


def test_region_without_valid_days_keeps_nothing(spark):
    df = spark.createDataFrame([("a", "1970-01-01", 5.0)], "series_id string, d string, power double")
    assert capacity.repair_old_dates(df.select("series_id", F.to_date("d").alias("day"), "power")).count() == 0
