"""Feature tables for forecasting and for training, as one lazy plan each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotide import SERIES, TS
from heliotide.functions.calendar import ZONE
from heliotide.operators.align import between_times, clip_to, hourly_mean, join_hourly
from heliotide.operators.features import (
    add_forecast_features, add_past_features, add_time_features, sequences,
)
from heliotide.operators.normalize import WINDOW_ROWS, SeriesNormaliser
from heliotide.operators.ordered import KeySizes
from heliotide.operators.quality import WEATHER_RANGES, require_columns
from heliotide.operators.shape import add_suffix, drop_unshifted
from heliotide.operators.spatial import central_and_dispersion
from heliotide.operators.split import validation_split
from heliotide.sources.readers import expand_weather


@dataclass
class FeatureConfig:
    """What the feature tables hold; the defaults are the full settings.

    Fixed values: the defaults must equal the published ones.
    """

    target: str = "solaire"
    variables: Sequence[str] = tuple(WEATHER_RANGES)
    central: int = 13
    past_features: Sequence[str] = ("solaire",)
    past_lags: Sequence[int] = (1, 6, 24, 48)
    past_windows: Sequence[int] = (6, 24, 48)
    forecast_leads: Sequence[int] = (1, 3, 6, 9, 12, 16, 24)
    forecast_deltas: Sequence[int] = (1, 6, 12, 24)
    periods: Mapping[str, int] = field(default_factory=lambda: {"month": 12, "hour": 24})
    forecast_hours: int = 48
    grid: str = "rows"
    #: The clock that bounds, hours and months are read off.
    zone: str = ZONE


def production_table(records: DataFrame, config: FeatureConfig, start: str | None = None, end: str | None = None) -> DataFrame:
    """Hourly production per series; training mode gives both bounds."""
    require_columns(records, [SERIES, TS, config.target])
    if (start is None) != (end is None):
        raise ValueError("give both start and end, or neither")
    if start is not None:
        records = between_times(records, start, end, zone=config.zone)
    return hourly_mean(records, [config.target])


def weather_table(responses: DataFrame, config: FeatureConfig, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Weather responses -> central value, spread and deviation per series and hour."""
    points = expand_weather(responses, config.variables, (*keys, "point_id"))
    return central_and_dispersion(points, config.variables, config.central, (*keys, TS))


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (SERIES, TS)]


def inference_table(
    production: DataFrame, past: DataFrame, forecast: DataFrame, config: FeatureConfig, sizes: KeySizes | None = None
) -> DataFrame:
    """Rows of the past-weather range with past, forecast and time features.

    Leads are taken on the whole forecast before the join, so the last known
    hour sees the hours to come. ``sizes`` are the series of ``production``.
    """
    past = clip_to(past, production, sizes=sizes)
    ahead = add_suffix(clip_to(forecast, production, config.forecast_hours - 1, sizes))
    behind = add_past_features(
        join_hourly(past, production), config.past_features, config.past_lags, config.past_windows, config.grid
    )
    leads = add_forecast_features(ahead, _columns(ahead), config.forecast_leads, config.forecast_deltas, config.grid)
    joined = join_hourly(behind, drop_unshifted(leads, _columns(ahead)), "right")
    return add_time_features(clip_to(joined, past, sizes=sizes), config.periods, config.zone)


def training_table(
    production: DataFrame, past: DataFrame, forecast: DataFrame, config: FeatureConfig, leads_first: bool = True,
    sizes: KeySizes | None = None,
) -> DataFrame:
    """Hours with production, past weather and forecast, and their features.

    ``leads_first`` computes leads on the whole forecast, as the inference
    table does. Without it the tables are joined first and leads count joined
    rows.
    """
    past, ahead = clip_to(past, production, sizes=sizes), add_suffix(forecast)
    if leads_first:
        behind = add_past_features(
            join_hourly(past, production), config.past_features, config.past_lags, config.past_windows, config.grid
        )
        leads = add_forecast_features(ahead, _columns(ahead), config.forecast_leads, config.forecast_deltas, config.grid)
        full = join_hourly(behind, drop_unshifted(leads, _columns(ahead)))
    else:
        base = join_hourly(join_hourly(past, ahead), production)
        behind = add_past_features(base, config.past_features, config.past_lags, config.past_windows, config.grid)
        leads = add_forecast_features(
            behind, _columns(ahead), config.forecast_leads, config.forecast_deltas, config.grid
        )
        full = drop_unshifted(leads, _columns(ahead))
    return add_time_features(full, config.periods, config.zone)


def sequence_tables(
    df: DataFrame,
    covariates: Sequence[str],
    encoder: Sequence[str],
    decoder: Sequence[str],
    target: str,
    past: int = 48,
    future: int = 24,
    stride: int = 1,
    share: float = 0.25,
    window: int = WINDOW_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Training and validation samples for sequence models.

    The normaliser is fitted on the training rows and applied to both parts;
    no sample spans the two.
    """
    split = validation_split(df, share)
    parts = [split.where(F.col("role") == role).drop("role") for role in ("train", "validation")]
    model = SeriesNormaliser(covariates, target, window=window).fit(parts[0]).stored()
    first, second = (
        sequences(model.transform(part), encoder, decoder, target, past, future, stride) for part in parts
    )
    return first, second
