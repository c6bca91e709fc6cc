"""Run log, saved models and the alias that names the one in use."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotide.functions.scaling import horizon_tag
from heliotide.learning.boosting import HorizonModel, MultiHorizonModel
from heliotide.operators.normalize import SeriesNormaliserModel
from heliotide.sources import schemas
from heliotide.sources.tables import read_table, upsert

ALIAS = "champion"


def run_records(spark: SparkSession, model: MultiHorizonModel, run_id: str, logged_at: datetime) -> DataFrame:
    """One row per horizon: set, tag, number of features, RMSE, parameters, tags."""
    rows = [
        (
            run_id, logged_at, h, part.feature_set, None, len(part.features), float(part.rmse),
            {k: str(v) for k, v in part.params.items()},
            {"model_family": "boosted_trees", "training_type": "multihorizon", "feature_set": part.feature_set,
             "is_baseline": str(part.feature_set == "short")},
        )
        for h, part in sorted(model.horizons.items())
    ]
    records = spark.createDataFrame(rows, schemas.RUNS).withColumn("horizon_tag", horizon_tag())
    tagged = F.map_concat("tags", F.create_map(F.lit("horizon_bucket"), F.col("horizon_tag")))
    return records.withColumn("tags", tagged)


def log_run(spark: SparkSession, model: MultiHorizonModel, path: str, run_id: str | None = None) -> str:
    """Append the run to the run table."""
    run_id = run_id or uuid.uuid4().hex
    upsert(run_records(spark, model, run_id, datetime.now(timezone.utc)), path, ["run_id", "horizon"], "logged_at", "logged_at")
    return run_id


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, ["run_id", "horizon"], "logged_at", schemas.RUNS)


def publish_model(spark: SparkSession, model: MultiHorizonModel, root: str, alias: str = ALIAS) -> str:
    """Save under a new version and point ``alias`` to it (M9)."""
    now = datetime.now(timezone.utc)
    version = f"{now:%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"
    folder = f"{root}/models/{version}"
    norm = model.normaliser
    norm.bounds.write.parquet(f"{folder}/bounds")
    norm.denominators.write.parquet(f"{folder}/denominators")
    lines = []
    for h, part in model.horizons.items():
        part.trees.save(f"{folder}/trees/{h}")
        lines.append((h, part.feature_set, part.features, float(part.rmse), json.dumps(part.params)))
    meta = spark.createDataFrame(lines, "horizon int, feature_set string, features array<string>, rmse double, params string")
    meta.withColumns({
        "covariates": F.array(*map(F.lit, norm.covariates)).cast("array<string>"), "target": F.lit(norm.target),
    }).write.parquet(f"{folder}/meta")
    pointer = spark.createDataFrame([(alias, version, now)], "alias string, version string, set_at timestamp")
    upsert(pointer, f"{root}/aliases", ["alias"], "set_at", "set_at")
    return version


def resolve_alias(spark: SparkSession, root: str, alias: str = ALIAS) -> str:
    """Version the alias points to (M9)."""
    pointers = read_table(spark, f"{root}/aliases", ["alias"], "set_at")
    row = pointers.where(F.col("alias") == alias).first()
    if row is None:
        raise ValueError(f"no model has the alias {alias!r}")
    return row["version"]


def load_model(spark: SparkSession, root: str, alias: str = ALIAS) -> MultiHorizonModel:
    """Model the alias points to (M9)."""
    folder = f"{root}/models/{resolve_alias(spark, root, alias)}"
    meta = spark.read.parquet(f"{folder}/meta").collect()
    normaliser = SeriesNormaliserModel(
        list(meta[0]["covariates"]), meta[0]["target"],
        spark.read.parquet(f"{folder}/bounds"), spark.read.parquet(f"{folder}/denominators"),
    )
    horizons = {
        r["horizon"]: HorizonModel(
            r["horizon"], r["feature_set"], list(r["features"]),
            GBTRegressionModel.load(f"{folder}/trees/{r['horizon']}"), r["rmse"], json.loads(r["params"]),
        )
        for r in meta
    }
    return MultiHorizonModel(normaliser, horizons)
