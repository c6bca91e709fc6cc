import numpy as np
import pandas as pd
from conftest import ordered, per_series, same, to_spark

from heliotide.operators import stats


def complete(hourly, spark):
    pdf = hourly[0].assign(y=hourly[0].y.fillna(0.0))
    return pdf, to_spark(spark, pdf)


def test_shape_matches_pandas(hourly, spark):
    pdf, df = complete(hourly, spark)
    got = ordered(stats.distribution_shape(df, "y"), "series_id").set_index("series_id")
    for k, p in pdf.groupby("series_id"):
        same(got.loc[k, ["skewness", "kurtosis"]], [p.y.skew(), p.y.kurt()], 1e-8)
        z = (p.y - p.y.mean()) / p.y.std(ddof=0)
        jb = len(p) / 6 * ((z**3).mean() ** 2 + ((z**4).mean() - 3) ** 2 / 4)
        same([got.loc[k, "jarque_bera"], got.loc[k, "p_value"]], [jb, np.exp(-jb / 2)], 1e-8)
    small = to_spark(spark, pd.DataFrame({"series_id": ["a", "a"], "y": [1.0, 2.0]}))
    assert stats.distribution_shape(small, "y").first().skewness is None


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": np.where(rng.random(500) < 0.5, 0.0, rng.normal(size=500)), "b": rng.integers(0, 9, 500) * 1.0})
    pdf["c"] = pdf.a * 2 + rng.normal(size=500)
    df = to_spark(spark, pdf)
    both = stats.correlation_difference(df, ["a", "b", "c"]).toPandas().set_index(["a", "b"])
    for name in ("pearson", "spearman"):
        want = pdf.corr(method=name)
        for a in pdf:
            for b in pdf:
                same(both.loc[(a, b), name], want.loc[a, b])


def test_histogram_and_box(hourly, spark):
    pdf, df = complete(hourly, spark)
    got = stats.histogram(df, "y", 10).toPandas()
    for k, p in pdf.groupby("series_id"):
        counts, edges = np.histogram(p.y, 10)
        mine = got[got.series_id == k].set_index("bin")
        assert [int(mine.n.get(i, 0)) for i in range(10)] == list(counts)
        same(mine.low, edges[mine.index])
        same((mine.density * (mine.high - mine.low)).sum(), 1)
    box = stats.box_summary(df, "y", ["series_id"]).toPandas().set_index("series_id")
    for k, p in pdf.groupby("series_id"):
        same(box.loc[k, ["q1", "median", "q3"]], p.y.quantile([0.25, 0.5, 0.75]))


def test_autocorrelations(hourly, spark):
    pdf, df = complete(hourly, spark)
    acf = stats.autocorrelation(df, "y", 12)
    got, pacf = ordered(acf, "series_id", "lag"), ordered(stats.partial_autocorrelation(acf), "series_id", "lag")
    for k, p in pdf.sort_values("ts").groupby("series_id"):
        d = (p.y - p.y.mean()).to_numpy()
        want = np.array([(d[j:] * d[: len(d) - j]).sum() for j in range(13)]) / (d * d).sum()
        same(got[got.series_id == k].acf, want)
        direct = [1.0]
        for j in range(1, 13):
            toeplitz = want[np.abs(np.subtract.outer(np.arange(j), np.arange(j)))]
            direct.append(np.linalg.solve(toeplitz, want[1 : j + 1])[-1])
        same(pacf[pacf.series_id == k].pacf, direct, 1e-8)


def test_cross_correlation(hourly, spark):
    pdf, df = complete(hourly, spark)
    got = stats.cross_correlation(df, ["x"], "y", 6).toPandas()
    for k, p in pdf.sort_values("ts").groupby("series_id"):
        x, y = (p[c] - p[c].mean() for c in ("x", "y"))
        want = [(x.to_numpy()[j:] * y.to_numpy()[: len(y) - j]).sum() / (len(p) * p.x.std(ddof=0) * p.y.std(ddof=0)) for j in range(6)]
        same(got[got.series_id == k].sort_values("lag").ccf, want)


def test_decomposition(spark):
    n = 24 * 10
    ts = pd.date_range("2024-01-01", periods=n, freq="h")
    pdf = pd.DataFrame({"series_id": "a", "ts": ts, "y": 0.1 * np.arange(n) + np.sin(2 * np.pi * ts.hour / 24)})
    got = ordered(stats.decompose_additive(to_spark(spark, pdf), "y"))
    assert got.trend.isna().sum() == 24
    same(got.trend[12:-12], 0.1 * np.arange(n)[12:-12], 1e-8)
    same(got.seasonal, np.sin(2 * np.pi * ts.hour / 24), 1e-8)
    assert got.remainder.abs().max() < 1e-8


def test_line_fit(hourly, spark):
    pdf, df = complete(hourly, spark)
    got = ordered(stats.line_fit(df, "y", "x"), "series_id")
    for k, p in pdf.groupby("series_id"):
        slope, intercept = np.polyfit(p.x, p.y, 1)
        row = got[got.series_id == k]
        same([row.slope.item(), row.intercept.item()], [slope, intercept], 1e-7)
    assert len(per_series(pdf, lambda p: p)) == len(pdf)
