import numpy as np
import pandas as pd
import pytest
from conftest import ordered, same, to_spark
from pyspark.sql import functions as F

from heliotide.operators.quantiles import average_ranks, exact_quantiles, summaries, with_average_rank


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    groups = [
        pd.DataFrame({"k": "normal", "v": rng.normal(size=3000)}),
        pd.DataFrame({"k": "ties", "v": np.where(rng.random(2000) < 0.6, 0.0, rng.integers(0, 5, 2000))}),
        pd.DataFrame({"k": "one", "v": [7.5]}),
        pd.DataFrame({"k": "two", "v": [1.0, 2.0]}),
        pd.DataFrame({"k": "gap", "v": [np.nan, 1.0, 4.0, np.nan, 9.0]}),
        pd.DataFrame({"k": "none", "v": [np.nan]}),
    ]
    pdf = pd.concat(groups, ignore_index=True)
    return pdf, to_spark(spark, pdf)


@pytest.mark.parametrize("slices", [2, 8, 64])
def test_quantiles_match_pandas(values, slices):
    pdf, df = values
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    got = exact_quantiles(df, ["k"], "v", probs, names, slices).toPandas().set_index("k")
    assert "none" not in got.index
    for k, part in pdf.dropna().groupby("k"):
        same(got.loc[k, names], part.v.quantile(probs))


def test_ranks_match_pandas(values):
    pdf, df = values
    got = average_ranks(df, ["k"], "v", slices=8).toPandas()
    known = pdf.dropna()
    want = known.assign(avg_rank=known.groupby("k").v.rank()).drop_duplicates()
    both = got.merge(want, on=["k", "v"])
    assert len(both) == len(got) == len(want)
    same(both.avg_rank_x, both.avg_rank_y)
    assert ordered(average_ranks(df, [], "v"), "v").avg_rank.is_monotonic_increasing


@pytest.mark.parametrize("slices", [2, 64])
def test_summaries_match_pandas(values, slices):
    pdf, df = values
    got = summaries(df, ["k"], "v", [0.25, 0.75], ["q1", "q3"], slices).toPandas().set_index("k")
    assert set(got.index) == set(pdf.k)
    for k, part in pdf.groupby("k"):
        v = part.v.dropna()
        assert (got.loc[k, "n"], got.loc[k, "n_null"]) == (len(v), part.v.isna().sum())
        same(got.loc[k, ["mean", "std", "min", "max", "q1", "q3"]], [v.mean(), v.std(), v.min(), v.max(), v.quantile(0.25), v.quantile(0.75)])


def test_summaries_keep_the_digits_of_large_close_values(spark):
    v = 1e9 + np.arange(1000) / 1000
    got = summaries(to_spark(spark, pd.DataFrame({"k": "a", "v": v})), ["k"], "v", [0.5], ["p50"]).first()
    assert abs(got["std"] - v.std(ddof=1)) < 1e-6 and abs(got["mean"] - v.mean()) < 1e-6


def test_rows_of_a_common_value_do_not_meet_in_one_task(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": np.where(rng.random(6000) < 0.7, 1.0, rng.normal(size=6000).round(3)), "b": np.arange(6000.0), "n": rng.integers(1, 4, 6000)})
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        ranked = with_average_rank(to_spark(spark, pdf), "a", "rank", "n")
        got = ranked.withColumn("task", F.spark_partition_id()).toPandas().sort_values("b")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got.task.value_counts().max() < 2400
    every = pdf.loc[pdf.index.repeat(pdf.n)]
    same(got["rank"], every.a.rank().groupby(level=0).first())
