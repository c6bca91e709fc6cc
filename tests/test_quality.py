import numpy as np
import pandas as pd
import pytest
from conftest import ordered, per_series, same, to_spark
from pyspark.sql import functions as F

from heliotide.operators import quality
from heliotide.operators.align import fill_hour_grid


def test_contracts_have_all_columns():
    assert len(quality.weather_contract()) == 24 and len(quality.production_contract()) == 1


def test_contract_report(spark):
    df = spark.createDataFrame([("a", 1, "5", 1.0), ("a", 1, "x", -1.0), ("b", 2, None, None)], "series_id string, ts int, n string, v double")
    rules = [quality.Range("n", 0, 4), quality.Range("v", 0, 1, True), quality.Range("gone", 0, 1)]
    got = {(r["column"], r["rule"]): r["n_bad"] for r in quality.contract_report(df, rules).collect()}
    assert got == {
        ("n", "type"): 1, ("n", "not_null"): 1, ("n", "min"): 0, ("n", "max"): 1,
        ("v", "type"): 0, ("v", "min"): 1, ("v", "max"): 0, ("gone", "missing"): 1, ("series_id,ts", "unique"): 1,
    }
    broken = {tuple(r.broken) for r in quality.contract_violations(df, rules).collect()}
    assert broken == {("n:max",), ("n:type", "v:min"), ("n:not_null",)}
    assert quality.coerce(df, rules).dtypes[2] == ("n", "double")


def test_guards(spark):
    df = spark.createDataFrame([("a", None)], "series_id string, y double")
    with pytest.raises(ValueError, match="missing"):
        quality.require_columns(df, ["y", "ts"])
    with pytest.raises(ValueError, match="value"):
        quality.check_has_values(df, "y")
    with pytest.raises(ValueError):
        quality.check_has_values(df.limit(0), "y")


def test_outliers_match_pandas(hourly, spark):
    pdf, _ = hourly
    pdf = pdf.copy()
    pdf.loc[pdf.index[:3], "y"] = 10_000.0

    def flags(p):
        q1, q3 = p.y.quantile([0.25, 0.75])
        iqr = (p.y <= q1 - 1.5 * (q3 - q1)) | (p.y >= q3 + 1.5 * (q3 - q1))
        z = ((p.y - p.y.mean()) / p.y.std()).abs() > 3
        return p.assign(iqr_outlier=iqr, z_outlier=z, outlier=iqr & z)

    got, want = ordered(quality.flag_outliers(to_spark(spark, pdf), "y")), per_series(pdf, flags)
    for c in ("iqr_outlier", "z_outlier", "outlier"):
        assert list(got[c]) == list(want[c])
    assert got.outlier.any()


def test_missing_runs_with_open_end(spark):
    n = np.nan
    y = [1, n, 2, n, n, 3, n, n, n, 4, n, n]
    pdf = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=len(y), freq="h"), "y": y})
    got = ordered(quality.missing_runs(to_spark(spark, pdf), "y", 1), "start")
    assert list(got.run_no) == [2, 3, 4] and list(got.n_missing) == [2, 3, 2]
    assert list(got.open) == [False, False, True]
    assert quality.missing_runs(to_spark(spark, pdf), "y", 3).count() == 0
    full = fill_hour_grid(to_spark(spark, pdf.dropna()))
    assert quality.missing_runs(full, "y", 1).count() == 2


def test_summary_and_profile(hourly):
    pdf, df = hourly
    row = quality.summary(df).first()
    assert (row.n_rows, row.n_columns, row.n_nulls) == (len(pdf), 4, int(pdf.isna().sum().sum()))
    profile = quality.column_profile(df, True).toPandas().set_index("column")
    assert abs(profile.loc["x", "p50"] - pdf.x.quantile(0.5)) < 1e-9
    assert profile.loc["y", "n_null"] == pdf.y.isna().sum()
    twice = quality.duplicate_share(df.unionAll(df)).first()
    assert twice.duplicate_pct == 50.0


def test_profile_of_an_empty_table_and_of_texts(hourly):
    df = hourly[1].withColumn("t", F.when(F.col("y") > 50, "a"))
    empty = quality.column_profile(df.limit(0), True).toPandas().set_index("column")
    assert list(empty.index) == df.columns and (empty.n_null == 0).all() and empty.p50.isna().all()
    full = quality.column_profile(df, True).toPandas().set_index("column")
    plain = quality.column_profile(df).toPandas().set_index("column")
    assert full.loc["t", "n_null"] == plain.loc["t", "n_null"] and np.isnan(full.loc["t", "mean"])
    for c in ("mean", "std", "min", "max"):
        same(full.loc[["x", "y"], c], plain.loc[["x", "y"], c])


def test_several_columns_are_judged_in_one_scan(hourly, tmp_path):
    hourly[1].write.parquet(str(tmp_path / "t"))
    df = hourly[1].sparkSession.read.parquet(str(tmp_path / "t"))
    both = quality.flag_outliers(df, ["x", "y"], 0.5, 1.5)
    got = ordered(both)
    for c in ("x", "y"):
        one = ordered(quality.flag_outliers(df, c, 0.5, 1.5))
        for flag in ("iqr_outlier", "z_outlier", "outlier"):
            assert list(got[f"{c}_{flag}"]) == list(one[flag]) and one[flag].any()
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the rows once, and one pass over the values of both columns
    assert plan.count("Scan parquet") == 2
    profile = quality.column_profile(df, True)
    profile.collect()
    assert profile._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Scan parquet") == 1


def test_missing_runs_of_several_columns(hourly, spark):
    grid = fill_hour_grid(hourly[1])
    both = quality.missing_runs(grid, ["x", "y"], 0).toPandas()
    for c in ("x", "y"):
        want = ordered(quality.missing_runs(grid, c, 0), "series_id", "start")
        got = both[both.column == c].sort_values(["series_id", "start"]).reset_index(drop=True)
        assert len(want) > 3 and got.drop(columns="column")[list(want.columns)].equals(want)
