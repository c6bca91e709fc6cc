import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from conftest import ordered, same, to_spark
from pyspark.sql import functions as F

from heliotide.operators import evaluate, publish, shape, split


def line(spark, n=100):
    pdf = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "y": np.random.default_rng(4).random(n)})
    return pdf, to_spark(spark, pdf)


def test_walk_forward_matches_a_loop(spark):
    pdf, df = line(spark)
    want = [
        (pdf.ts[s - 1], h, pdf.ts[s + h - 1], pdf.y[s + h - 1], pdf.y[s + h - 25])
        for s in range(48, 100 - 24, 5) for h in range(1, 25)
    ]
    got = ordered(evaluate.walk_forward(df, "y", stride=5), "origin_ts", "horizon")
    assert len(got) == len(want)
    assert list(zip(got.origin_ts, got.horizon, got.target_ts)) == [w[:3] for w in want]
    same(got[["actual", "baseline"]], [w[3:] for w in want])


def test_metrics(spark):
    pdf, df = line(spark)
    walk = evaluate.walk_forward(df, "y").withColumn("prediction", F.lit(0.5))
    frame = walk.toPandas()
    err, base = frame.actual - 0.5, frame.actual - frame.baseline
    row = evaluate.error_summary(walk).first()
    same([row.rmse, row.mae, row.mape], [np.sqrt((err**2).mean()), err.abs().mean(), (err / (frame.actual + 1e-6)).abs().mean() * 100])
    table = evaluate.skill_table(walk).toPandas()
    total = table[table.horizon.isna()].iloc[0]
    same(total.skill, 1 - np.sqrt((err**2).mean()) / np.sqrt((base**2).mean()))
    assert len(table) == 25


def test_publishing(spark):
    t = datetime(2024, 1, 1, 10)
    wide = spark.createDataFrame([("a", t, 125.4, 130.2), ("a", datetime(2024, 1, 1, 6), 1.0, 2.0)], "series_id string, ts timestamp, `+1h` double, `+24h` double")
    long = shape.melt_predictions(wide)
    nested = publish.nested_latest(long).first()
    assert nested.predicted_at == t
    assert [(p.forecast_horizon, p.predicted_value) for p in nested.predictions] == [(datetime(2024, 1, 1, 11), 125.4), (datetime(2024, 1, 2, 10), 130.2)]
    assert publish.nested_latest(long.limit(0)).count() == 0
    text = publish.with_text_times(long).where("predicted_value = 125.4").first()
    assert text.forecast_horizon == "2024-01-01 11:00:00"
    factors = spark.createDataFrame([("a", 10.0, t), ("a", 2.0, datetime(2023, 1, 1))], "series_id string, p99_value double, computed_at timestamp")
    assert publish.rescale_predictions(long, factors).where("predicted_value = 1254.0").count() == 1
    numbered = long.withColumn("horizon", ((F.unix_seconds("forecast_horizon") - F.unix_seconds("predicted_at")) / 3600).cast("int"))
    again = shape.pivot_horizons(numbered, [1, 24], keys=("series_id", "predicted_at"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, wide.collect()))


def test_splits(spark):
    _, df = line(spark, 35)
    roles = ordered(split.ordered_split(df, "y")).role.tolist()
    tests = math.ceil(35 * 0.2)
    assert roles == ["train"] * (35 - tests) + ["test"] * tests
    assert ordered(split.validation_split(df)).role.tolist().count("validation") == 35 - int(35 * 0.75)
    folds = split.expanding_folds(df, 4).toPandas().sort_values(["fold", "ts"])
    assert list(folds[folds.role == "test"].groupby("fold").size()) == [7, 7, 7, 7]
    for _, part in folds.groupby("fold"):
        assert part[part.role == "train"].ts.max() < part[part.role == "test"].ts.min()
    assert folds[folds.role == "test"].ts.is_unique


def test_drift_is_zero_for_the_same_values_and_flags_a_shift(spark):
    rng = np.random.default_rng(1)
    frames = [pd.DataFrame({"series_id": s, "y": rng.normal(size=2000)}) for s in "ab"]
    reference = to_spark(spark, pd.concat([*frames, pd.DataFrame({"series_id": ["c", "c"], "y": [np.nan, np.nan]})]))
    frames[1] = frames[1].assign(y=frames[1].y + 1.0)
    current = to_spark(spark, pd.concat([*frames, pd.DataFrame({"series_id": ["a", "d"], "y": [np.nan, 1.0]})]))
    edges = evaluate.drift_edges(reference, "y")
    got = {r.series_id: r for r in evaluate.drift_index(reference, current, edges, "y").collect()}
    assert sorted(got) == ["a", "b"] and (got["a"].n_reference, got["a"].n_current) == (2000, 2000)
    assert got["a"].drift == 0.0 and not got["a"].drifted and got["b"].drift > 0.5 and got["b"].drifted


def test_symmetric_error_by_group(spark):
    rows = spark.createDataFrame([("day", 0.0, 0.0), ("day", 1.0, 3.0), ("night", 2.0, 2.0), ("night", None, 1.0)], "sky string, actual double, prediction double")
    got = {r.sky: (r.n, r.smape) for r in evaluate.symmetric_error(rows, by=["sky"]).collect()}
    assert got == {"day": (2, pytest.approx(50.0)), "night": (1, 0.0)}
