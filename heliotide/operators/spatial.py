"""Weather at several points reduced to one row per hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotide import TS


def split_central(df: DataFrame, central: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the central point, and all others."""
    return df.where(F.col("point_id") == central), df.where(F.col("point_id") != central)


def central_and_dispersion(
    df: DataFrame,
    variables: Sequence[str],
    central: int,
    keys: Sequence[str] = (TS,),
    places: int | None = 4,
) -> DataFrame:
    """Per hour: value at the central point, and spread and deviation of the others.

    One grouping gives all three, so no self-join is needed. A missing central
    point leaves NULL.
    """
    own, other = F.col("point_id") == central, F.col("point_id") != central
    aggs: list[Column] = []
    for v in variables:
        outer = F.when(other, F.col(v))
        aggs += [
            F.max(F.when(own, F.col(v))).alias(v),
            _rounded(F.max(outer) - F.min(outer), places).alias(f"{v}_delta_minmax"),
            _rounded(F.stddev_samp(outer), places).alias(f"{v}_std"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def _rounded(x: Column, places: int | None) -> Column:
    return x if places is None else F.bround(x, places)


def weighted_centres(df: DataFrame, key: str, weight: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Weighted mean position per ``key`` and overall (A5).

    ``overall`` is true on the row for all sites, where ``key`` is NULL.
    """
    total = F.sum(weight)
    return df.groupingSets([[F.col(key)], []], F.col(key)).agg(
        F.try_divide(F.sum(F.col(lat) * F.col(weight)), total).alias("lat"),
        F.try_divide(F.sum(F.col(lon) * F.col(weight)), total).alias("lon"),
        total.alias("weight"),
        (F.grouping(key) == 1).alias("overall"),
    )
