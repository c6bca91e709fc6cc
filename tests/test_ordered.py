import uuid

import pandas as pd
import pytest
from conftest import ordered, per_series, same, to_spark
from pyspark.sql import functions as F

from heliotide.operators import align, features, normalize, quality
from heliotide.operators import ordered as o
from heliotide.operators import stats as stats_ops
from heliotide.operators.align import hourly_mean


def test_positions_cross_blocks(hourly):
    pdf, df = hourly
    got = ordered(o.number_rows(df, total="n", block_days=1))
    want = per_series(pdf, lambda p: p.assign(pos=range(len(p)), n=len(p)))
    assert list(got.pos) == list(want.pos)
    assert list(got.n) == list(want.n)


@pytest.mark.parametrize("chunk_rows", [1, 7, 50, 4096])
def test_frames_are_exact_at_chunk_edges(hourly, chunk_rows):
    pdf, df = hourly
    build = lambda w: {
        "back": F.sum("y").over(w.rowsBetween(-5, -1)), "ahead": F.lead("y", 3).over(w), "lag": F.lag("y", 4).over(w),
    }
    got = ordered(o.over_rows(df, build, back=5, ahead=3, chunk_rows=chunk_rows, block_days=2))
    want = per_series(pdf, lambda p: p.assign(
        back=p.y.shift(1).rolling(5, min_periods=1).sum(), ahead=p.y.shift(-3), lag=p.y.shift(4)))
    for c in ("back", "ahead", "lag"):
        same(got[c], want[c])
    assert len(got) == len(pdf)


def test_running_sum(hourly):
    pdf, df = hourly
    got = ordered(o.running_sum(df.fillna(0.0), "y", "s", block_days=1))
    same(got.s, per_series(pdf, lambda p: p.assign(s=p.y.fillna(0).cumsum())).s)


def test_no_window_over_a_whole_series(hourly):
    plan = o.over_rows(hourly[1], lambda w: {"l": F.lag("y", 1).over(w)}, back=1)
    text = plan._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in text.splitlines() if " Window [" in line or "+- Window" in line]
    assert keys and all("_block" in k or "_chunk" in k for k in keys)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_raw_records_are_scanned_once(hourly, tmp_path):
    hourly[1].write.parquet(str(tmp_path / "raw"))
    raw = hourly[1].sparkSession.read.parquet(str(tmp_path / "raw"))
    df = o.over_rows(hourly_mean(raw, ["y"]), lambda w: {"l": F.lag("y", 1).over(w)}, back=1)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") == 1 and "ReusedExchange" in final


def test_reserved_names_are_refused(hourly):
    with pytest.raises(ValueError, match="rename"):
        o.over_rows(hourly[1].withColumn("pos", F.lit(1)), lambda w: {}, back=1)


def _jobs_while(spark, build):
    """Spark jobs that start while ``build`` runs, and what it returns."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "building")
    try:
        return build(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_key_sizes_count_keys_and_name_the_hot_ones(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("series_id"), "id")
    sizes = o.key_sizes(rows, hot_rows=500)
    assert sizes == o.KeySizes(("series_id",), 101, ((2000, "hot"),))
    assert o.key_sizes(rows.limit(0)) == o.KeySizes(("series_id",), 0, ())
    two = o.key_sizes(rows.withColumn("k", F.col("id") % 2), ["series_id", "k"], hot_rows=500)
    assert {h[1:] for h in two.hot} == {("hot", 0), ("hot", 1)}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_gives_the_same_rows_all_ways(spark, how):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("series_id"), "id")
    rows = rows.union(spark.sql("SELECT CAST(NULL AS STRING), 9999L"))
    stats = rows.where("series_id <> 'k2500'").groupBy("series_id").agg(F.count("*").alias("n"))
    sizes = o.key_sizes(rows, hot_rows=300)
    ways = [
        o.attach(rows, stats, how=how), o.attach(rows, stats, how=how, sizes=sizes), o.attach(rows, stats, how=how, sizes=sizes, broadcast_bytes=0),
        o.attach_spread(rows, stats, sizes, how, hot_rows=300), o.attach_spread(rows, stats, o.KeySizes(("series_id",), 5), how),
    ]
    first, *others = [sorted(df.select("series_id", "id", "n").collect(), key=lambda r: r["id"]) for df in ways]
    assert len(first) == (3001 if how == "left" else 2999) and first[0]["n"] == 2000
    assert all(other == first for other in others)
    with pytest.raises(ValueError, match="sizes are of"):
        o.attach(rows, stats, ["id"], sizes=sizes)


def test_only_hot_keys_are_copied(spark):
    """One hot and 10**5 cold keys: the statistics have one row per cold key and a few for the hot one."""
    rows = spark.range(300_000).select(F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id")).alias("series_id"), "id")
    stats = rows.groupBy("series_id").agg(F.count("*").alias("n"))
    sizes = o.key_sizes(rows, hot_rows=20_000)
    assert sizes.n_keys == 100_001 and [h[1] for h in sizes.hot] == [-1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = o.attach_spread(rows, stats, sizes, hot_rows=20_000)
        assert o.copied_stats(stats, sizes, 20_000).count() == 100_000 + 200_000 // 20_000
        assert joined.where("series_id = -1").select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert joined.where("n IS NOT NULL").count() == 300_000
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.autoBroadcastJoinThreshold", "adaptive.coalescePartitions.enabled"):
            spark.conf.unset(f"spark.sql.{name}")


def test_attach_does_not_move_rows_when_the_table_is_known_to_be_small(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        spark.range(5000).select(F.lit("hot").alias("series_id"), F.col("id").cast("timestamp").alias("ts"), "id").write.parquet(str(tmp_path / "r"))
        rows = spark.read.parquet(str(tmp_path / "r"))
        stats = rows.groupBy("series_id").agg(F.avg("id").alias("m"))
        near = o.attach(rows, stats, sizes=o.key_sizes(rows))
        assert near.count() == 5000
        plan = near._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        # the one exchange is that of the statistics
        assert "BroadcastHashJoin" in final and final.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_operators_run_nothing_while_they_are_built(spark, hourly):
    df = hourly[1]
    steps = {
        "standardise": lambda: features.standardise(df, ["x"]),
        "flag_outliers": lambda: quality.flag_outliers(df, "y"),
        "box_summary": lambda: stats_ops.box_summary(df, "y", ["series_id"]),
        "normaliser": lambda: normalize.SeriesNormaliser(["x"]).fit(df).transform(df),
        "spearman": lambda: stats_ops.spearman(df, ["x", "y"]),
        "clip_to": lambda: align.clip_to(df, df),
    }
    for name, step in steps.items():
        assert _jobs_while(spark, step)[1] == 0, name


def test_normaliser_computes_the_rolling_quantile_once(hourly, tmp_path):
    hourly[1].write.parquet(str(tmp_path / "t"))
    df = hourly[1].sparkSession.read.parquet(str(tmp_path / "t"))
    out = normalize.SeriesNormaliser(["x"]).fit(df).transform(df)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FlatMapGroupsInPandas") == 1 and "ReusedExchange" in final


def test_last_per_key_and_empty_input(spark, hourly):
    pdf, df = hourly
    got = ordered(o.last_per_key(df, ["series_id"], ["ts"]), "series_id")
    want = pdf.sort_values("ts").groupby("series_id").tail(1).sort_values("series_id")
    assert list(got.ts) == list(want.ts)
    empty = df.limit(0)
    assert o.number_rows(empty).count() == 0
    assert o.over_rows(empty, lambda w: {"l": F.lag("y", 1).over(w)}, back=1).count() == 0


def test_instants_before_the_epoch(spark):
    pdf = pd.DataFrame({"series_id": "a", "ts": pd.date_range("1969-12-30", periods=96, freq="h"), "y": range(96)})
    df = to_spark(spark, pdf).withColumn("ts", F.col("ts").cast("timestamp"))
    assert list(ordered(o.number_rows(df, block_days=1)).pos) == list(range(96))
