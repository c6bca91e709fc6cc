"""Ordered splits of a series into training and test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotide.operators.ordered import number_rows
from heliotide.operators.quality import require_columns


def ordered_split(df: DataFrame, target: str, test_share: float = 0.2) -> DataFrame:
    """Add ``role``: the last ceil(n * share) rows of each series are ``test`` (M1)."""
    require_columns(df, [target])
    numbered = number_rows(df, "_pos", "_n")
    test = F.ceil(F.col("_n") * F.lit(float(test_share)))
    role = F.when(F.col("_pos") >= F.col("_n") - test, "test").otherwise("train")
    return numbered.withColumn("role", role).drop("_pos", "_n")


def validation_split(df: DataFrame, share: float = 0.25) -> DataFrame:
    """Add ``role``: rows from int(n * (1 - share)) on are ``validation`` (M2)."""
    numbered = number_rows(df, "_pos", "_n")
    first = F.floor(F.col("_n") * F.lit(1.0 - share))
    role = F.when(F.col("_pos") >= first, "validation").otherwise("train")
    return numbered.withColumn("role", role).drop("_pos", "_n")


def expanding_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """Rows with ``fold`` 1..k and ``role`` (M3).

    Block size is n // (k + 1); fold i tests the i-th of the last k blocks and
    trains on every row before it. Each row is emitted once per fold it is
    used in, so no fold table is joined.
    """
    numbered = number_rows(df, "_pos", "_n")
    size = F.floor(F.col("_n") / (folds + 1))
    each = numbered.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    first = F.col("_n") - (F.lit(folds + 1) - F.col("fold")) * size
    used = each.where(F.col("_pos") < first + size)
    role = F.when(F.col("_pos") >= first, "test").otherwise("train")
    return used.withColumn("role", role).drop("_pos", "_n")
