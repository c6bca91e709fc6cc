"""Walk-forward tables and forecast errors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotide import SERIES, TS
from heliotide.functions.calendar import horizon_of
from heliotide.operators.ordered import attach, over_rows
from heliotide.operators.quantiles import exact_quantiles

HORIZONS = 24
MAPE_SHIFT = 1e-6


def walk_forward(
    df: DataFrame,
    target: str,
    horizons: int = HORIZONS,
    first_origin: int = 48,
    stride: int = 1,
) -> DataFrame:
    """One row per origin and horizon with actual value and persistence forecast.

    Origins are row numbers from ``first_origin`` up to but not including
    n - ``horizons``. ``origin_ts`` is the last known hour before the origin;
    horizon h targets row origin + h - 1, and persistence repeats the value
    ``horizons`` rows before the target. Every target row is expanded to the
    origins that forecast it, so no self-join is needed.
    """
    def build(w):
        return {
            "_origins": F.array(*[F.lag(TS, h).over(w) for h in range(1, horizons + 1)]),
            "baseline": F.lag(target, horizons).over(w),
        }

    framed = over_rows(df.select(SERIES, TS, target), build, back=horizons, keep=("pos", "n_rows"))
    long = framed.select("*", F.posexplode("_origins").alias("_i", "origin_ts"))
    origin = F.col("pos") - F.col("_i")
    valid = (
        (origin >= first_origin)
        & (origin < F.col("n_rows") - horizons)
        & ((origin - first_origin) % stride == 0)
    )
    return long.where(valid).select(
        SERIES, "origin_ts", (F.col("_i") + 1).alias("horizon"), F.col(TS).alias("target_ts"),
        F.col(target).alias("actual"), "baseline",
    )


def predictions_by_origin(wide: DataFrame, factor: str | None = None) -> DataFrame:
    """``+1h .. +24h`` predictions made at each row -> ``(series_id, origin_ts, horizon, prediction)``.

    ``factor`` names the column that undoes the normalisation of that row, such
    as its denominator.
    """
    horizons = [c for c in wide.columns if re.fullmatch(r"\+\d+h", c)]
    long = wide.unpivot([SERIES, TS, *([factor] if factor else [])], [f"`{c}`" for c in horizons], "_label", "_value")
    value = F.col("_value") * F.col(factor) if factor else F.col("_value")
    return long.select(SERIES, F.col(TS).alias("origin_ts"), horizon_of("_label").alias("horizon"), value.alias("prediction"))


def join_predictions(walk: DataFrame, predictions: DataFrame) -> DataFrame:
    """Add ``prediction`` from ``(series_id, origin_ts, horizon, prediction)``.

    An origin without a prediction keeps its row with NULL; ``prediction_coverage`` counts such rows.
    """
    return walk.join(predictions, [SERIES, "origin_ts", "horizon"], "left")


def prediction_coverage(df: DataFrame, by: Sequence[str] = (SERIES, "horizon")) -> DataFrame:
    """Rows with an actual value, and how many of them lack a prediction."""
    known = F.col("actual").isNotNull()
    return df.groupBy(*by).agg(
        F.count_if(known).alias("n_actual"), F.count_if(known & F.col("prediction").isNull()).alias("n_missing")
    )


def error_summary(df: DataFrame, actual: str = "actual", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and MAPE in percent, its denominator shifted by 1e-6."""
    error = F.col(actual) - F.col(prediction)
    return df.groupBy(*by).agg(
        F.count(error).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.avg(F.abs(F.try_divide(error, F.col(actual) + MAPE_SHIFT))) * 100).alias("mape"),
    )


def skill_table(df: DataFrame, by: Sequence[str] = (SERIES,)) -> DataFrame:
    """RMSE, MAE and skill over the baseline, overall and per horizon.

    ``horizon`` is NULL on the overall rows. Skill is 1 - RMSE / baseline RMSE.
    """
    error, base = F.col("actual") - F.col("prediction"), F.col("actual") - F.col("baseline")
    keys = [F.col(k) for k in by]
    grouped = df.groupingSets([[*keys, F.col("horizon")], keys], *keys, F.col("horizon")).agg(
        F.count(error).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(base * base)).alias("rmse_baseline"),
    )
    return grouped.withColumn("skill", 1 - F.try_divide("rmse", "rmse_baseline"))


def drift_edges(reference: DataFrame, value: str, bins: int = 10, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """``(keys, edges)``: inner quantiles of the reference values, to be kept with the model they belong to."""
    names = [f"_e{i}" for i in range(1, bins)]
    found = exact_quantiles(reference, keys, value, [i / bins for i in range(1, bins)], names)
    return found.select(*keys, F.array(*names).alias("edges"))


def drift_index(
    reference: DataFrame, current: DataFrame, edges: DataFrame, value: str, bins: int = 10, keys: Sequence[str] = (SERIES,),
    smoothing: float = 0.5, limit: float = 0.25,
) -> DataFrame:
    """``(keys, n_reference, n_current, drift, drifted)``: how far the values moved between the bins of ``edges``.

    Sum over bins of (p - q) ln(p / q) with ``smoothing`` added to every count;
    ``drifted`` from ``limit`` on. A value lies in the bin after the edges below
    it. Missing values count nothing; keys without edges are left out.
    """
    side = lambda df, name: df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"), F.lit(name).alias("_side"))
    both = attach(side(reference, "r").union(side(current, "c")), edges, keys, "inner")
    place = both.select(*keys, "_side", F.size(F.filter("edges", lambda e: e < F.col("_x"))).alias("_bin"))
    met = place.groupBy(*keys).agg(*[
        F.count_if((F.col("_side") == s) & (F.col("_bin") == i)).alias(f"_{s}{i}") for s in "rc" for i in range(bins)
    ])
    total = {s: sum((F.col(f"_{s}{i}") for i in range(bins)), F.lit(0)) for s in "rc"}

    def share(s: str, i: int) -> Column:
        return (F.col(f"_{s}{i}") + smoothing) / (total[s] + smoothing * bins)

    drift = sum(((share("c", i) - share("r", i)) * F.ln(share("c", i) / share("r", i)) for i in range(bins)), F.lit(0.0))
    return met.select(*keys, total["r"].alias("n_reference"), total["c"].alias("n_current"), drift.alias("drift")).withColumn(
        "drifted", F.col("drift") >= limit
    )


def symmetric_error(df: DataFrame, actual: str = "actual", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Mean of 2 |a - p| / (|a| + |p|) in percent per group; rows where both are zero count as no error."""
    a, p = F.col(actual), F.col(prediction)
    size = F.abs(a) + F.abs(p)
    error = F.when(size == 0, F.lit(0.0)).otherwise(2 * F.abs(a - p) / size)
    return df.groupBy(*by).agg(F.count(error).alias("n"), (F.avg(error) * 100).alias("smape"))
