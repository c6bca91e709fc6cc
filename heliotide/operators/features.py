"""Feature columns built from neighbouring rows of a series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from heliotide import SERIES, TS
from heliotide.functions.calendar import ZONE, add_cyclic
from heliotide.operators.align import fill_hour_grid
from heliotide.operators.ordered import KeySizes, attach, over_rows


def past_columns(
    w: WindowSpec, features: Sequence[str], lags: Sequence[int], windows: Sequence[int]
) -> dict[str, Column]:
    """Lag, moving mean, volatility and ramp columns.

    The moving frames end one row before the current one.
    """
    columns = {}
    for c in features:
        for k in lags:
            columns[f"{c}_lag_t-{k}"] = F.lag(c, k).over(w)
        for n in windows:
            before = w.rowsBetween(-n, -1)
            columns[f"{c}_ma_{n}"] = F.avg(c).over(before)
            columns[f"{c}_volatility_{n}"] = F.stddev_samp(c).over(before)
            columns[f"{c}_ramp_{n}"] = F.lag(c, 1).over(w) - F.lag(c, n + 1).over(w)
    return columns


def forecast_columns(
    w: WindowSpec, features: Sequence[str], leads: Sequence[int], deltas: Sequence[int]
) -> dict[str, Column]:
    """Value k rows ahead, and its difference to the current one."""
    columns = {}
    for c in features:
        for k in leads:
            columns[f"{c}_t+{k}"] = F.lead(c, k).over(w)
        for k in deltas:
            columns[f"{c}_delta_t+{k}_t"] = F.lead(c, k).over(w) - F.col(c)
    return columns


def add_past_features(
    df: DataFrame,
    features: Sequence[str],
    lags: Sequence[int],
    windows: Sequence[int],
    grid: str = "rows",
) -> DataFrame:
    """Past features of every listed column, in one window pass.

    ``grid="rows"`` counts rows, so a lag may span a gap; ``grid="hours"``
    counts hours by filling the grid first and dropping the filler rows after.
    """
    back = max([*lags, *[n + 1 for n in windows]])
    return _on_grid(df, grid, lambda d: over_rows(
        d, lambda w: past_columns(w, features, lags, windows), back=back
    ))


def add_forecast_features(
    df: DataFrame,
    features: Sequence[str],
    leads: Sequence[int],
    deltas: Sequence[int],
    grid: str = "rows",
) -> DataFrame:
    """Forecast features of every listed column, in one window pass."""
    ahead = max([*leads, *deltas])
    return _on_grid(df, grid, lambda d: over_rows(
        d, lambda w: forecast_columns(w, features, leads, deltas), ahead=ahead
    ))


def _on_grid(df: DataFrame, grid: str, add) -> DataFrame:
    if grid == "rows":
        return add(df)
    if grid != "hours":
        raise ValueError(f"grid must be 'rows' or 'hours', not {grid!r}")
    marked = df.withColumn("_real", F.lit(True))
    return add(fill_hour_grid(marked)).where("_real").drop("_real")


def seasonal_difference(df: DataFrame, value: str, lag: int = 24, name: str | None = None) -> DataFrame:
    """x[t] - x[t - lag]; rows without both values are dropped."""
    name = name or f"{value}_diff_{lag}"
    diff = over_rows(df, lambda w: {name: F.col(value) - F.lag(value, lag).over(w)}, back=lag)
    return diff.where(F.col(name).isNotNull())


def rolling_mean(df: DataFrame, value: str, window: int = 640, name: str | None = None) -> DataFrame:
    """Mean over the last ``window`` rows including this one, full frames only."""
    def build(w):
        frame = w.rowsBetween(-(window - 1), 0)
        full = F.count(value).over(frame) == window
        return {name or f"{value}_mean_{window}": F.when(full, F.avg(value).over(frame))}

    return over_rows(df, build, back=window - 1)


def add_targets(df: DataFrame, target: str, horizons: Sequence[int]) -> DataFrame:
    """All horizons as columns ``{target}_h{h}`` = y[t+h]; missing at the end."""
    return over_rows(
        df,
        lambda w: {f"{target}_h{h}": F.lead(target, h).over(w) for h in horizons},
        ahead=max(horizons),
    )


def align_to_target(df: DataFrame, target: str, horizon: int, name: str = "label") -> DataFrame:
    """Rows whose target ``horizon`` rows ahead exists, with it as ``label``."""
    shifted = over_rows(df, lambda w: {name: F.lead(target, horizon).over(w)}, ahead=horizon)
    return shifted.where(F.col(name).isNotNull())


def targets_long(df: DataFrame, target: str, horizons: Sequence[int]) -> DataFrame:
    """One row per row and horizon: ``horizon, label``."""
    wide = add_targets(df.select(SERIES, TS, target), target, horizons)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"{target}_h{h}").alias("label")) for h in horizons
    ]))
    return wide.select(SERIES, TS, pairs.alias("_p")).select(SERIES, TS, "_p.*").where("label is not null")


def sequences(
    df: DataFrame,
    encoder: Sequence[str],
    decoder: Sequence[str],
    target: str,
    past: int = 48,
    future: int = 24,
    stride: int = 1,
) -> DataFrame:
    """Sliding samples for sequence models, complete windows only.

    ``x_past`` holds encoder columns and the target for ``past`` rows,
    ``x_future`` the decoder columns and ``y`` the target for the ``future``
    rows after them. Arrays have a fixed length.
    """
    span = past + future

    def build(w):
        frame = w.rowsBetween(0, span - 1)
        row = F.struct(
            F.array(*encoder, target).alias("e"), F.array(*decoder).alias("d"), F.col(target).alias("y")
        )
        return {"_rows": F.collect_list(row).over(frame)}

    base = df.select(SERIES, TS, *dict.fromkeys([*encoder, *decoder, target]))
    framed = over_rows(base, build, ahead=span - 1, keep=("pos",))
    starts = framed.where((F.size("_rows") == span) & (F.col("pos") % stride == 0))
    return starts.select(
        SERIES,
        F.col(TS).alias("start"),
        F.slice("_rows.e", 1, past).alias("x_past"),
        F.slice("_rows.d", past + 1, future).alias("x_future"),
        F.slice("_rows.y", past + 1, future).alias("y"),
    )


def standardise(df: DataFrame, values: Sequence[str], sizes: KeySizes | None = None) -> DataFrame:
    """(x - mean) / sample std per series; a constant column gives NULL."""
    stats = df.groupBy(SERIES).agg(
        *[F.avg(v).alias(f"_mean_{v}") for v in values],
        *[F.stddev_samp(v).alias(f"_std_{v}") for v in values],
    )
    scaled = {v: F.try_divide(F.col(v) - F.col(f"_mean_{v}"), F.col(f"_std_{v}")) for v in values}
    joined = attach(df, stats, sizes=sizes)
    return joined.select(*[scaled[c].alias(c) if c in scaled else c for c in df.columns])


def add_time_features(df: DataFrame, periods: Mapping[str, int] | None = None, zone: str = ZONE) -> DataFrame:
    """Cyclic month and hour, the defaults of the feature table (F1), by the clock of ``zone``."""
    return add_cyclic(df, periods or {"month": 12, "hour": 24}, zone=zone)


def pareto_select(
    gains: DataFrame, threshold: float = 0.95, inclusive: bool = False, by: Sequence[str] = ("horizon",)
) -> DataFrame:
    """Features by falling gain whose cumulative share stays below ``threshold``.

    ``gains(by..., feature, gain)`` has one row per model feature, so the
    window is as small as the number of columns. Ties go by name.
    """
    ranked = Window.partitionBy(*by).orderBy(F.desc("gain"), "feature")
    share = F.try_divide(
        F.sum("gain").over(ranked.rowsBetween(Window.unboundedPreceding, 0)),
        F.sum("gain").over(Window.partitionBy(*by)),
    )
    kept = F.col("share") <= threshold if inclusive else F.col("share") < threshold
    return gains.withColumn("share", share).where(kept)
