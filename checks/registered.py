"""Collects the registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must give the same rows."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Both sides round computed doubles, whose last bits depend on summation order.

    The number of places is chosen so that exact halves cannot occur: means of
    values in hundredths end after a few decimals.
    """
    return df.select([
        F.round(F.col(f"`{c}`").cast("double"), places).alias(c) if c in columns else F.col(f"`{c}`")
        for c in df.columns
    ])


def r(expression: str, name: str, places: int = 6) -> str:
    quoted = f'"{name}"'
    return f"round(CAST({expression} AS DOUBLE), {places}) AS {quoted}"


def rs(names: Sequence[str], places: int = 6) -> str:
    return ", ".join(r(f'"{n}"', n, places) for n in names)
