"""Models and the three jobs end to end on a small region."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliotide.learning import boosting, registry
from heliotide.operators.publish import nested_latest
from heliotide.plans import feature_tables, jobs
from heliotide.sources import schemas

HOURS = 220
START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def region(spark):
    rng = np.random.default_rng(0)
    records = [
        ("76", START + timedelta(minutes=15 * i), float(max(0, np.sin(i / 4 * np.pi / 12)) * 100 + rng.random()))
        for i in range(HOURS * 4)
    ]
    production = spark.createDataFrame(records, "series_id string, ts timestamp, solaire double")

    def weather(hours):
        rows = [
            ("76", p, START, START + timedelta(hours=hours), 3600,
             {v: [float(50 + p + i % 24) for i in range(hours)] for v in ("cloud_cover", "global_tilted_irradiance")})
            for p in range(14)
        ]
        return spark.createDataFrame(rows, schemas.WEATHER_RESPONSE)

    config = feature_tables.FeatureConfig(
        variables=("cloud_cover", "global_tilted_irradiance"), past_lags=(1, 24), past_windows=(6,),
        forecast_leads=(1, 24), forecast_deltas=(1,),
    )
    return production, weather(HOURS), weather(HOURS + 48), config


def test_tables_agree_where_both_are_defined(region):
    production, past, forecast, config = region
    prod = feature_tables.production_table(production, config)
    weather = [feature_tables.weather_table(w, config) for w in (past, forecast)]
    live = feature_tables.inference_table(prod, *weather, config)
    train = feature_tables.training_table(prod, *weather, config)
    joined_first = feature_tables.training_table(prod, *weather, config, leads_first=False)
    assert sorted(live.columns) == sorted(train.columns) == sorted(joined_first.columns)
    assert live.count() == train.count() == HOURS
    last = train.orderBy(F.desc("ts")).first()
    assert last["cloud_cover_forecast_t+24"] is not None
    assert joined_first.orderBy(F.desc("ts")).first()["cloud_cover_forecast_t+24"] is None
    names = sorted(live.columns)
    assert live.select(names).exceptAll(train.select(names)).count() == 0
    with pytest.raises(ValueError):
        feature_tables.production_table(production, config, start="2024-01-01")


def test_jobs_end_to_end(spark, region, tmp_path):
    production, past, forecast, config = region
    layout = jobs.Layout(str(tmp_path))
    table = jobs.build_training(production, past, forecast, layout, config, "2024-03-01", "2024-04-01")
    assert table.count() == HOURS
    training = boosting.TrainingConfig.small(horizons=(1, 24), trials=2)
    covariates = ["cloud_cover", "global_tilted_irradiance"]
    model = jobs.run_training(spark, layout, covariates, config.target, training)
    assert sorted(model.horizons) == [1, 24]
    runs = registry.read_runs(spark, layout.runs).orderBy("horizon").collect()
    assert [(r.feature_set, r.horizon_tag) for r in runs] == [("short", "short"), ("long", "long")]
    assert all(r.tags["horizon_bucket"] == r.horizon_tag and np.isfinite(r.rmse) for r in runs)

    now = (START + timedelta(hours=HOURS)).replace(tzinfo=timezone.utc)
    factor = jobs.refresh_quantile(production, layout, config, now=now).first().p99_value
    predictions = jobs.run_forecast(production, past, forecast, layout, config, now=now).orderBy("forecast_horizon").collect()
    last_hour = START + timedelta(hours=HOURS - 1)
    assert [p.forecast_horizon for p in predictions] == [last_hour + timedelta(hours=1), last_hour + timedelta(hours=24)]
    assert all(0 <= p.predicted_value <= 2 * factor for p in predictions)
    assert nested_latest(spark.createDataFrame(predictions)).count() == 1
    # a second run replaces the rows of the same hour
    assert jobs.run_forecast(production, past, forecast, layout, config, hours=None).count() == 2
    with pytest.raises(ValueError, match="longest"):
        jobs.run_forecast(production, past, forecast, layout, config, hours=24)
    with pytest.raises(ValueError):
        registry.resolve_alias(spark, layout.root, "other")


def test_search_space_is_seeded_and_bounded():
    points = boosting.sample_params(boosting.SEARCH_RANGES, 50, 1)
    assert points == boosting.sample_params(boosting.SEARCH_RANGES, 50, 1)
    assert all(0.005 <= p["stepSize"] <= 0.2 and 1 <= p["maxDepth"] <= 30 for p in points)


def test_selection_falls_back_to_the_strongest(spark, monkeypatch):
    gains = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.0)], "horizon int, feature string, gain double")
    monkeypatch.setattr(boosting, "fit_gains", lambda *a, **k: gains)
    assert boosting.fit_selected_features(gains, ["a", "b"], "y", [1], {}) == ["a"]


def test_jobs_read_only_what_they_need(spark, region, tmp_path):
    production = region[0]
    production.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    now = (START + timedelta(hours=HOURS)).replace(tzinfo=timezone.utc)
    few = jobs.recent(stored, 10, now)
    assert few.count() == 40
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan.split("PushedFilters")[1]
    assert jobs.recent(stored, None, now) is stored


def test_refreshed_quantile_is_that_of_all_records(spark, region, tmp_path):
    """Longer days, and series that ended long ago, give what a read of everything gives."""
    config, end = region[3], datetime(2024, 12, 1)
    ends = {"live": 0, "late": 3, "gone": 250}
    rows = [(s, end - timedelta(days=k + i), float(i)) for s, k in ends.items() for i in range(1, 240)]
    records = spark.createDataFrame(rows, "series_id string, ts timestamp, solaire double")
    value = lambda df: {r["series_id"]: r["p99_value"] for r in df.collect()}
    now = end.replace(tzinfo=timezone.utc)
    for days in (90, 180):
        with pytest.warns(UserWarning, match="2 series .*gone, late"):
            got = value(jobs.refresh_quantile(records, jobs.Layout(str(tmp_path / f"a{days}")), config, days=days, now=now))
        everything = value(jobs.refresh_quantile(records, jobs.Layout(str(tmp_path / f"b{days}")), config, days=days, hours=None))
        assert got == everything and got.keys() == ends.keys() and got["live"] == pytest.approx(1 + 0.99 * (days - 1))
    with pytest.raises(ValueError, match="180 days"):
        jobs.refresh_quantile(records, jobs.Layout(str(tmp_path / "c")), config, days=180, hours=24 * 91)


def test_a_fold_without_test_values_is_no_silent_loss(spark):
    rows = [(fold, role, float(i), float(i), 1.0) for fold in (1, 2) for role in ("train", "test") for i in range(30) if (fold, role) != (2, "test")]
    df = spark.createDataFrame(rows, "fold int, role string, x double, label double, denominator double").withColumn("actual", F.col("label"))
    table = boosting.assemble(df, ["x"])
    flat = {"maxDepth": 0, "maxIter": 1}
    with pytest.raises(ValueError, match="fold 2"):
        boosting.search(table, 2, [flat])
    error, best = boosting.search(table.withColumn("fold", F.lit(1)), 1, [flat, {"maxDepth": 3, "maxIter": 3, "minInstancesPerNode": 1}])
    assert best["maxDepth"] == 3 and error < 5


def test_features_are_selected_on_the_rows_of_the_fold(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(fold, role, "1#a", i) for fold in (1, 2) for role in ("train", "test") for i in range(fold)], "fold int, role string, series_id string, i int"
    )
    seen = []

    def chosen(part, features, *rest):
        seen.append({(r["fold"], r["role"]) for r in part.collect()})
        return features[: len(seen)]

    monkeypatch.setattr(boosting, "fit_selected_features", chosen)
    config = boosting.TrainingConfig(parallel=1)
    found = boosting.fold_features(rows, ["a", "b"], "y", 2, [1], config)
    assert seen == [{(1, "train")}, {(2, "train")}] and found == {1: ["a"], 2: ["a", "b"]}


def test_fold_tables_take_each_folds_own_features(spark):
    rows = spark.createDataFrame(
        [(f, r, 1.0, 2.0, 3.0, 4.0, 5.0) for f in (1, 2) for r in ("train", "test")],
        "fold int, role string, a double, b double, label double, actual double, denominator double",
    )
    table = {(r["fold"], r["role"]): r["inputs"].toArray().tolist() for r in boosting.fold_table(rows, {1: ["b"], 2: ["a", "b"]}).collect()}
    assert table == {(1, "train"): [2.0], (1, "test"): [2.0], (2, "train"): [1.0, 2.0], (2, "test"): [1.0, 2.0]}
