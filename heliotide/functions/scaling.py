"""Scalar rules on values and horizons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def min_max(value: str, low: Column, high: Column) -> Column:
    """``(x - min) / (max - min)``, not clipped; a constant column divides by 1."""
    width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (F.col(value) - low) / width


def non_negative(value: str | Column) -> Column:
    """Negative values become 0, missing ones stay missing."""
    x = F.col(value) if isinstance(value, str) else value
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def target_columns(columns: Sequence[str], target: str) -> list[str]:
    """Columns derived from the target: those whose name contains it."""
    return [c for c in columns if target in c]


def training_set(horizon: str = "horizon") -> Column:
    """Feature set a horizon is trained with: up to 3 h, up to 12 h, beyond (F8)."""
    h = F.col(horizon)
    return F.when(h <= 3, "short").when(h <= 12, "mid").otherwise("long")


def horizon_tag(horizon: str = "horizon") -> Column:
    """Tag written to the run table: up to 6 h, up to 12 h, beyond."""
    h = F.col(horizon)
    return F.when(h <= 6, "short").when(h <= 12, "medium").otherwise("long")


def rescale(value: str, factor: str | float) -> Column:
    """Normalised prediction back to the unit of the target."""
    return F.col(value) * (F.col(factor) if isinstance(factor, str) else F.lit(factor))
