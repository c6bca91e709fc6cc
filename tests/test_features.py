import numpy as np
import pandas as pd
from conftest import ordered, per_series, same, to_spark

from heliotide.functions import calendar, scaling
from heliotide.operators import features, shape


def test_past_features_match_pandas(hourly):
    pdf, df = hourly
    got = ordered(features.add_past_features(df, ["y", "x"], [1, 5], [6]))

    def build(p):
        for c in ("y", "x"):
            prev = p[c].shift(1)
            for k in (1, 5):
                p[f"{c}_lag_t-{k}"] = p[c].shift(k)
            p[f"{c}_ma_6"] = prev.rolling(6, min_periods=1).mean()
            p[f"{c}_volatility_6"] = prev.rolling(6, min_periods=1).std()
            p[f"{c}_ramp_6"] = prev - p[c].shift(7)
        return p

    want = per_series(pdf, build)
    assert set(got.columns) == set(want.columns)
    for c in want.columns[2:]:
        same(got[c], want[c], 1e-8)


def test_past_features_ignore_the_future(spark, hourly):
    pdf, df = hourly
    changed = pdf.assign(y=np.where(pdf.ts > "2024-01-04", -1.0, pdf.y))
    cut = pd.Timestamp("2024-01-04")
    a, b = (ordered(features.add_past_features(d, ["y"], [1, 24], [6])) for d in (df, to_spark(spark, changed)))
    for c in a.columns[2:]:
        same(a.loc[a.ts <= cut, c], b.loc[b.ts <= cut, c])


def test_forecast_features_and_hour_grid(hourly):
    pdf, df = hourly
    got = ordered(features.add_forecast_features(df, ["x"], [1, 3], [2]))
    want = per_series(pdf, lambda p: p.assign(**{"x_t+1": p.x.shift(-1), "x_t+3": p.x.shift(-3), "x_delta_t+2_t": p.x.shift(-2) - p.x}))
    for c in ("x_t+1", "x_t+3", "x_delta_t+2_t"):
        same(got[c], want[c])
    by_hour = ordered(features.add_past_features(df, ["x"], [24], [], grid="hours"))
    want = per_series(pdf, lambda p: p.assign(l=p.set_index("ts").x.shift(freq="24h").reindex(p.ts).to_numpy()))
    same(by_hour["x_lag_t-24"], want.l)
    assert len(by_hour) == len(pdf)


def test_targets_and_sequences(spark):
    n = 90
    pdf = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "y": np.arange(n, dtype=float), "x": np.arange(n) * 10.0})
    df = to_spark(spark, pdf)
    assert features.align_to_target(df, "y", 24).count() == n - 24
    assert features.targets_long(df, "y", range(1, 25)).count() == sum(n - h for h in range(1, 25))
    seq = ordered(features.sequences(df, ["x"], ["x"], "y", stride=5), "start")
    assert len(seq) == len(range(0, n - 72 + 1, 5))
    first = seq.iloc[1]
    assert [list(r) for r in first.x_past[:2]] == [[50.0, 5.0], [60.0, 6.0]]
    assert list(first.y) == [float(i) for i in range(53, 77)]
    assert [list(r) for r in first.x_future[:1]] == [[530.0]]


def test_differences_means_and_standardise(hourly):
    pdf, df = hourly
    got = ordered(features.seasonal_difference(df, "x", 24))
    want = per_series(pdf, lambda p: p.assign(d=p.x.diff(24)).dropna(subset=["d"]))
    same(got.x_diff_24, want.d)
    got = ordered(features.rolling_mean(df, "x", 40))
    same(got.x_mean_40, per_series(pdf, lambda p: p.assign(m=p.x.rolling(40).mean())).m)
    got = ordered(features.standardise(df, ["x"]))
    same(got.x, per_series(pdf, lambda p: p.assign(x=(p.x - p.x.mean()) / p.x.std())).x)


def test_cyclic_and_calendar(spark):
    ts = pd.to_datetime(["2024-03-31 06:00", "2024-12-02 23:00"])
    df = to_spark(spark, pd.DataFrame({"series_id": "a", "ts": ts}))
    got = ordered(calendar.add_cyclic(df, {"month": 12, "hour": 24, "day": 365}))
    for part, period in (("month", 12), ("hour", 24), ("day", 365)):
        angle = 2 * np.pi * getattr(ts, part) / period
        same(got[f"{part}_sin"], np.round(np.sin(angle), 5))
        same(got[f"{part}_cos"], np.round(np.cos(angle), 5))
    parts = ordered(calendar.add_calendar(df))
    assert list(parts.weekday) == [6, 0]


def test_pareto_rule(spark):
    gains = spark.createDataFrame([(1, "a", 60.0), (1, "b", 30.0), (1, "c", 10.0), (2, "a", 100.0)], "horizon int, feature string, gain double")
    got = {(r.horizon, r.feature) for r in features.pareto_select(gains, 0.9).collect()}
    assert got == {(1, "a")}
    closed = {(r.horizon, r.feature) for r in features.pareto_select(gains, 0.9, inclusive=True).collect()}
    assert closed == {(1, "a"), (1, "b")}


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "v_run_13 int, v_run_130 int, v_run_13_std int")
    assert shape.strip_run(df, 13).columns == ["v", "v_run_130", "v_std"]
    assert shape.keep_matching(df, ["std"]).columns == ["v_run_13_std"]
    encoder, decoder = shape.encoder_decoder(["cloud_forecast_t+1", "hour_sin", "y_lag_t-1"])
    assert encoder == ["hour_sin", "y_lag_t-1"] and decoder == ["cloud_forecast_t+1", "hour_sin"]


def test_scalar_rules(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (2.0,)], "x double")
    assert [r[0] for r in df.select(scaling.non_negative("x")).collect()] == [0.0, None, 2.0]
    h = spark.createDataFrame([(3,), (6,), (12,), (13,)], "horizon int")
    assert [tuple(r) for r in h.select(scaling.training_set(), scaling.horizon_tag()).collect()] == [
        ("short", "short"), ("mid", "short"), ("mid", "medium"), ("long", "long")]
    assert scaling.target_columns(["y_lag", "x", "ma_y"], "y") == ["y_lag", "ma_y"]
    labels = spark.createDataFrame([("+7h",), ("7h",)], "l string")
    assert [r[0] for r in labels.select(calendar.horizon_of("l")).collect()] == [7, None]


def test_duplicates_keep_the_last(spark):
    rows = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, None)], "series_id string, ts int, seq int, v string")
    assert shape.last_duplicate(rows, "seq").collect()[0].v is None
