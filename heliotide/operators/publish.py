"""Predictions as the serving side reads them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotide import SERIES
from heliotide.functions.calendar import as_text, wall_clock
from heliotide.functions.scaling import rescale
from heliotide.operators.ordered import attach
from heliotide.operators.shape import newest_predictions


def rescale_predictions(predictions: DataFrame, factors: DataFrame, value: str = "predicted_value") -> DataFrame:
    """Multiply normalised predictions by the newest factor of their series."""
    latest = factors.groupBy(SERIES).agg(F.max_by("p99_value", "computed_at").alias("_factor"))
    joined = attach(predictions, latest)
    return joined.select(*[rescale(value, "_factor").alias(c) if c == value else c for c in predictions.columns])


def with_text_times(
    df: DataFrame, columns: Sequence[str] = ("predicted_at", "forecast_horizon"), zone: str = "UTC"
) -> DataFrame:
    """Published text form of the time columns (F7); instants by the clock of ``zone``."""
    return df.withColumns({c: as_text(wall_clock(df, c, zone)) for c in columns})


def nested_latest(predictions: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Newest run per series as one row with its horizons in order.

    A run has one row per horizon, so the list is as long as the horizon count.
    """
    newest = newest_predictions(predictions, keys)
    entry = F.struct("forecast_horizon", "predicted_value")
    return newest.groupBy(*keys, "predicted_at").agg(F.sort_array(F.collect_list(entry)).alias("predictions"))
