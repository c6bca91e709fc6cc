"""The three jobs: forecast, training and refresh of the normalisation factor."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliotide import SERIES, TS
from heliotide.functions.calendar import bound
from heliotide.learning.boosting import MultiHorizonModel, TrainingConfig, train_horizons
from heliotide.learning.registry import load_model, log_run, publish_model
from heliotide.operators.evaluate import join_predictions, predictions_by_origin, walk_forward
from heliotide.operators.normalize import recent_quantile
from heliotide.operators.ordered import key_sizes
from heliotide.operators.publish import rescale_predictions
from heliotide.operators.quality import check_has_values
from heliotide.operators.shape import last_row, melt_predictions
from heliotide.operators.split import ordered_split
from heliotide.plans.feature_tables import (
    FeatureConfig, inference_table, production_table, training_table, weather_table,
)
from heliotide.session import cut_lineage
from heliotide.sources.tables import (
    latest_quantile, load_training_table, read_predictions, read_quantiles, read_table,
    upsert_predictions, upsert_quantiles, write_table,
)


#: Fixed value: how far back the forecast reads production.
FORECAST_HOURS = 99
#: The refresh reads its days and one to spare.
FROM_DAYS = "days"


def _staged(
    records: DataFrame, past: DataFrame, forecast: DataFrame, config: FeatureConfig, **bounds: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hourly production, past weather and forecast, each written once.

    The feature plan refers to them several times; the raw files are scanned
    only here.
    """
    production = cut_lineage(production_table(records, config, **bounds))
    check_has_values(production, config.target)
    return production, cut_lineage(weather_table(past, config)), cut_lineage(weather_table(forecast, config))


class Layout:
    """Table folders below one root."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.features = f"{self.root}/features"
        self.training = f"{self.root}/training"
        self.quantiles = f"{self.root}/quantiles"
        self.predictions = f"{self.root}/predictions"
        self.runs = f"{self.root}/runs"


def recent(df: DataFrame, hours: int | None, now: datetime | None, ts: str = TS) -> DataFrame:
    """Rows of the last ``hours`` before ``now`` (the present by default); the bound is a constant that scans can use.

    Without ``hours`` nothing is left out. ``ts`` is an instant, or zone-less UTC.
    """
    if hours is None:
        return df
    since = (now or datetime.now(timezone.utc)) - timedelta(hours=hours)
    return df.where(F.col(ts) >= bound(since.isoformat() if isinstance(df.schema[ts].dataType, T.TimestampType) else since.replace(tzinfo=None).isoformat(), df.schema[ts].dataType))


def ended_series(records: DataFrame, days: int, hours: int, now: datetime | None = None) -> DataFrame:
    """``series_id, newest`` of series whose last ``days`` are not within the last ``hours`` before ``now``."""
    newest = records.groupBy(SERIES).agg(F.max(TS).alias("newest"))
    live = recent(newest, hours - 24 * days, now, "newest")
    return newest.join(live.select(SERIES), SERIES, "left_anti")


def refresh_quantile(
    records: DataFrame, layout: Layout, config: FeatureConfig, days: int = 90, q: float = 0.99,
    hours: int | str | None = FROM_DAYS, now: datetime | None = None,
) -> DataFrame:
    """Quantile of the last days per series, kept for the forecast job.

    Days count back from each series' newest row. The last ``hours`` before
    ``now`` are read, by default the days and one to spare, and of all records
    the newest time per series. Series that ended too early for ``hours`` are
    named in a warning and read whole, so every series gets the value that
    ``hours=None``, which reads all, gives.
    """
    if hours == FROM_DAYS:
        hours = 24 * (days + 1)
    if hours is not None and hours < 24 * days:
        raise ValueError(f"{hours} hours do not hold {days} days")
    read = recent(records, hours, now)
    if hours is not None:
        ended = cut_lineage(ended_series(records, days, hours, now))
        some = [str(r[SERIES]) for r in ended.orderBy(SERIES).select(SERIES).limit(20).collect()]
        if some:
            warnings.warn(f"{ended.count()} series ended too early for {hours} hours and are read whole, such as {', '.join(some)}", stacklevel=2)
            read = read.join(ended, SERIES, "left_anti").unionByName(records.join(ended, SERIES, "left_semi"))
    hourly = production_table(read, config)
    factors = recent_quantile(hourly, config.target, days, q)
    upsert_quantiles(factors.withColumn("computed_at", F.current_timestamp()), layout.quantiles)
    return read_quantiles(records.sparkSession, layout.quantiles)


def predict_latest(features: DataFrame, factors: DataFrame, model: MultiHorizonModel) -> DataFrame:
    """Newest row per series -> long predictions in the unit of the target."""
    wide = model.predict_wide(last_row(features))
    return rescale_predictions(melt_predictions(wide), latest_quantile(factors))


def run_forecast(
    records: DataFrame, past: DataFrame, forecast: DataFrame, layout: Layout, config: FeatureConfig,
    hours: int | None = FORECAST_HOURS, now: datetime | None = None,
) -> DataFrame:
    """Features -> stored table -> prediction by the aliased model -> stored predictions.

    Only production of the last ``hours`` before ``now`` is read, which must
    hold the longest lag and window of ``config``; ``hours=None`` reads all.
    """
    spark = records.sparkSession
    reach = max([*config.past_lags, *config.past_windows])
    if hours is not None and hours <= reach:
        raise ValueError(f"{hours} hours do not hold the longest lag or window, {reach}")
    records = recent(records, hours, now)
    staged = _staged(records, past, forecast, config)
    table = inference_table(*staged, config, key_sizes(staged[0]))
    write_table(table, layout.features)
    stored = read_table(spark, layout.features)
    predictions = predict_latest(stored, read_quantiles(spark, layout.quantiles), load_model(spark, layout.root))
    upsert_predictions(predictions, layout.predictions)
    return read_predictions(spark, layout.predictions)


def walk_forward_of(
    model: MultiHorizonModel, table: DataFrame, target: str, first_origin: int = 48, stride: int = 1,
) -> DataFrame:
    """Forecasts of a trained model from every origin of ``table``.

    All horizons of all rows are scored in one pass and take the denominator of
    their origin's row. One row per origin and horizon: ``actual``, ``baseline``
    and ``prediction``, which is NULL where the model has none
    (``prediction_coverage`` counts those, ``skill_table`` sums up the errors).
    """
    made = predictions_by_origin(model.predict_wide(table, with_denominator=True), "denominator")
    return join_predictions(walk_forward(table, target, first_origin=first_origin, stride=stride), made)


def build_training(
    records: DataFrame, past: DataFrame, forecast: DataFrame, layout: Layout, config: FeatureConfig,
    start: str, end: str,
) -> DataFrame:
    """Training table for the closed range, stored."""
    staged = _staged(records, past, forecast, config, start=start, end=end)
    table = training_table(*staged, config, sizes=key_sizes(staged[0]))
    write_table(table, layout.training)
    return read_table(records.sparkSession, layout.training)


def run_training(
    spark: SparkSession, layout: Layout, covariates: Sequence[str], target: str,
    training: TrainingConfig | None = None, test_share: float = 0.2,
) -> MultiHorizonModel:
    """Train on the ordered training part, log the run, publish and alias the model."""
    table = load_training_table(spark, layout.training).drop("ts_local")
    train = ordered_split(table, target, test_share).where("role = 'train'").drop("role")
    features = [c for c in train.columns if c not in (SERIES, TS, target)]
    model = train_horizons(train, features, covariates, target, training)
    log_run(spark, model, layout.runs)
    publish_model(spark, model, layout.root)
    return model
