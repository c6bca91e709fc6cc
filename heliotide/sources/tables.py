"""Tables the jobs keep: parquet folders, replaced whole or upserted by day.

An upserted table is partitioned by the day of one time column. An upsert reads
the days it brings rows for, keeps the newest row per key, and replaces those
days alone, so it costs what it brings. One writer at a time per table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliotide import SERIES, TS
from heliotide.functions.calendar import ZONE, to_local, wall_clock
from heliotide.operators.ordered import last_per_key
from heliotide.session import cut_lineage
from heliotide.sources import schemas

#: Partition column of upserted tables.
DAY = "upsert_day"


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the table's content."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored rows, or None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_table(
    spark: SparkSession,
    path: str,
    keys: Sequence[str] = (),
    order: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Current content (S10); with ``keys`` the row with the highest ``order`` per key.

    With ``schema`` a table that was never written is empty.
    """
    rows = _existing(spark, path)
    if rows is None:
        if schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    rows = rows.drop(DAY)
    return last_per_key(rows, keys, [order]) if keys else rows


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Union where the highest ``order`` per key wins; ties go to ``new``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return last_per_key(both, keys, [order, "_new"]).drop("_new")


def _day(df: DataFrame, time: str) -> Column:
    """Day of ``time``; of instants by UTC, whatever the session's zone."""
    if isinstance(df.schema[time].dataType, T.TimestampType):
        return F.date_from_unix_date(F.floor(F.unix_seconds(time) / 86400).cast("int"))
    return F.col(time).cast("date")


def upserted(df: DataFrame, path: str, keys: Sequence[str], order: str, time: str) -> DataFrame:
    """The new content of the days that ``df`` has rows for."""
    new = df.withColumn(DAY, _day(df, time))
    old = _existing(df.sparkSession, path)
    if old is None:
        return last_per_key(new, [*keys, DAY], [order])
    # a delivery spans a few days; the list lets the scan skip all other folders
    days = [r[DAY] for r in new.select(DAY).distinct().collect()]
    return merge_latest(old.where(F.col(DAY).isin(days)).select(*new.columns), new, [*keys, DAY], order)


def upsert(df: DataFrame, path: str, keys: Sequence[str], order: str, time: str) -> None:
    """Rows of ``df`` replace stored ones of the same key and day of ``time`` unless those have a higher ``order``."""
    content = upserted(cut_lineage(df), path, keys, order, time)
    content.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


PREDICTION_KEYS = (SERIES, "predicted_at", "forecast_horizon")


def upsert_predictions(df: DataFrame, path: str) -> None:
    """Predictions keyed by series, run and horizon; a later call wins."""
    upsert(df, path, PREDICTION_KEYS, "predicted_at", "predicted_at")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schema=schemas.PREDICTIONS)


def upsert_quantiles(df: DataFrame, path: str) -> None:
    """Factors per series and day they were computed on."""
    upsert(df, path, [SERIES], "computed_at", "computed_at")


def read_quantiles(spark: SparkSession, path: str) -> DataFrame:
    """One factor per series, the newest by ``computed_at``."""
    return read_table(spark, path, [SERIES], "computed_at", schemas.QUANTILES)


def latest_quantile(df: DataFrame, keys: Sequence[str] = (SERIES,), not_finite: str = "raise") -> DataFrame:
    """Newest ``p99_value`` per series.

    A newest value that is missing or not finite fails the query. With
    ``not_finite="last"`` its series takes its newest finite value instead
    (NULL if it never had one), with the time of that value; the others are
    untouched, and ``stale_quantiles`` lists the series concerned.
    """
    value = F.col("p99_value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    if not_finite == "last":
        at = F.when(finite, F.col("computed_at"))
        return df.groupBy(*keys).agg(F.max_by(F.when(finite, value), at).alias("p99_value"), F.max(at).alias("computed_at"))
    if not_finite != "raise":
        raise ValueError(f"unknown rule {not_finite}")
    newest = df.groupBy(*keys).agg(
        F.max_by("p99_value", "computed_at").alias("p99_value"), F.max("computed_at").alias("computed_at")
    )
    bad = F.raise_error(F.lit("newest quantile is not a finite number")).cast("double")
    return newest.withColumn("p99_value", F.when(finite, value).otherwise(bad))


def stale_quantiles(df: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Series whose newest quantile is missing or not finite, with its time."""
    newest = df.groupBy(*keys).agg(F.max_by("p99_value", "computed_at").alias("v"), F.max("computed_at").alias("computed_at"))
    bad = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == F.lit(float("inf")))
    return newest.where(bad).drop("v")


def load_training_table(spark: SparkSession, path: str, zone: str = ZONE) -> DataFrame:
    """Training table with ``ts_local``, the wall-clock time in ``zone``."""
    df = read_table(spark, path)
    if isinstance(df.schema[TS].dataType, T.TimestampType):
        return df.withColumn("ts_local", wall_clock(df, TS, zone))
    return df.withColumn("ts_local", to_local(TS, zone))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with a header; times keep their microseconds."""
    df.write.options(
        header=True, sep=sep,
        timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    ).csv(path)


def write_feature_sets(spark: SparkSession, sets: dict[str, Sequence[str]], path: str) -> None:
    """Feature lists as ``(horizon_set, feature)``."""
    rows = [(name, feature) for name, features in sets.items() for feature in features]
    write_table(spark.createDataFrame(rows, schemas.FEATURE_SETS), path)


def read_feature_sets(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Feature lists back as a dict; as many rows as a model has columns."""
    grouped = read_table(spark, path).groupBy("horizon_set").agg(F.sort_array(F.collect_list("feature")).alias("f"))
    return {row["horizon_set"]: list(row["f"]) for row in grouped.collect()}
