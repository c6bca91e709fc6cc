"""Scaling of covariates and of the target by its rolling high quantile."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliotide import SERIES, TS
from heliotide.functions.calendar import add_hours
from heliotide.functions.scaling import min_max, target_columns
from heliotide.operators.ordered import (
    BLOCK, KeySizes, attach, block_window, key_sizes, number_rows, over_rows, spread_chunks,
    with_block, with_block_context,
)
from heliotide.session import cut_lineage

WINDOW_ROWS = 90 * 24
MIN_VALUES = 24


def recent_quantile(df: DataFrame, value: str, days: int = 90, q: float = 0.99) -> DataFrame:
    """Quantile of the last ``days`` days of each series (A3).

    Input is hourly with unique ``ts``, so a group holds at most 24 * days values.
    """
    newest = df.groupBy(SERIES).agg(add_hours(F.max(TS), -24 * days).alias("_after"))
    recent = attach(df, newest, how="inner").where(F.col(TS) > F.col("_after"))
    return recent.groupBy(SERIES).agg(
        F.percentile(value, q).alias("p99_value"), F.max(TS).alias("computed_at")
    )


def rolling_quantile(
    df: DataFrame,
    value: str,
    name: str = "denominator",
    window: int = WINDOW_ROWS,
    q: float = 0.99,
    min_values: int = MIN_VALUES,
    back_fill: bool = True,
    fast: bool = True,
    chunk_rows: int = 4 * WINDOW_ROWS,
) -> DataFrame:
    """Quantile of the last ``window`` rows including this one.

    Needs ``min_values`` known values; earlier rows then take the next known
    quantile. ``min_values=window, back_fill=False`` is the strict variant
    (W8). Rounded to single precision as the stored factor is.

    ``fast`` computes each chunk's values with pandas, whose rolling quantile updates a
    sorted window instead of sorting every frame anew; otherwise it is Spark's
    exact ``percentile`` on a row frame, the better choice for very many short
    series. All columns pass through, so select the needed ones first.
    """
    if fast:
        rolled = _rolling_in_chunks(df, value, window, q, min_values, chunk_rows)
    else:
        def build(w):
            frame = w.rowsBetween(-(window - 1), 0)
            enough = F.count(value).over(frame) >= min_values
            return {"_q": F.when(enough, F.percentile(value, q).over(frame))}

        rolled = over_rows(df, build, back=window - 1, chunk_rows=chunk_rows)
    if not back_fill:
        return rolled.select(*df.columns, F.col("_q").cast("float").alias(name))
    # dealt to blocks once: both sides of the join below read this exchange, so the quantile runs once
    blocks = with_block(rolled).repartition(SERIES, BLOCK)
    context = with_block_context(
        blocks, after_first={"_later": F.min_by("_q", F.when(F.col("_q").isNotNull(), F.col(TS)))}
    )
    onward = block_window().rowsBetween(0, Window.unboundedFollowing)
    next_known = F.coalesce(F.first("_q", ignorenulls=True).over(onward), F.col("_later"))
    return context.select(*df.columns, next_known.cast("float").alias(name))


def _rolling_in_chunks(df, value, window, q, min_values, chunk_rows) -> DataFrame:
    spread = spread_chunks(number_rows(df), back=window - 1, chunk_rows=chunk_rows)
    schema = T.StructType([*df.schema.fields, T.StructField("_q", T.DoubleType())])
    names = schema.fieldNames()

    def roll(part: pa.Table) -> pa.Table:
        # Only the values become pandas: its times end in the year 2262.
        part = part.sort_by("pos")
        values = part.column(value).to_pandas().astype("float64")
        rolled = values.rolling(window, min_periods=min_values).quantile(q)
        part = part.append_column("_q", pa.array(rolled, pa.float64()))
        own = part.column("pos").to_numpy() // chunk_rows == part.column("_chunk").to_numpy()
        return part.filter(pa.array(own)).select(names)

    rolled = spread.groupBy(SERIES, "_chunk").applyInArrow(roll, schema)
    known = {f.name for f in schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return rolled.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if c in known else F.col(f"`{c}`") for c in names])


def column_bounds(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Minimum and maximum of each column per series."""
    if not columns:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(
        *[F.min(c).alias(f"{c}_min") for c in columns], *[F.max(c).alias(f"{c}_max") for c in columns]
    )


def last_denominator(denominators: DataFrame) -> DataFrame:
    """Newest denominator of each series."""
    return denominators.groupBy(SERIES).agg(F.max_by("denominator", TS).alias("last_denominator"))


class SeriesNormaliser(Estimator):
    """Fits per series: min/max of covariates and the rolling quantile of the target (M4).

    Fit on the unshifted target. Fitting only defines plans; nothing runs
    until the result is used.
    """

    def __init__(
        self,
        covariates: Sequence[str],
        target: str = "y",
        window: int = WINDOW_ROWS,
        q: float = 0.99,
        min_values: int = MIN_VALUES,
    ):
        super().__init__()
        self.covariates, self.target = list(covariates), target
        self.window, self.q, self.min_values = window, q, min_values

    def _fit(self, dataset: DataFrame) -> SeriesNormaliserModel:
        present = [c for c in self.covariates if c in dataset.columns]
        bounds = column_bounds(dataset, present)
        rolled = rolling_quantile(
            dataset.select(SERIES, TS, self.target), self.target,
            window=self.window, q=self.q, min_values=self.min_values,
        )
        return SeriesNormaliserModel(
            # dealt by hour once: the last value per series and the join by hour read the same exchange
            present, self.target, bounds, rolled.select(SERIES, TS, F.col("denominator").cast("double")).repartition(SERIES, TS)
        )


class SeriesNormaliserModel(Model):
    """Scales covariates and target-derived columns; maps the target both ways.

    A row takes the denominator of its hour, or the last one of its series
    when its hour was not in the fit (J6).
    """

    def __init__(self, covariates, target, bounds: DataFrame, denominators: DataFrame, sizes: KeySizes | None = None):
        super().__init__()
        self.sizes = sizes
        self.covariates, self.target = covariates, target
        self.bounds, self.denominators = bounds, denominators

    def stored(self) -> SeriesNormaliserModel:
        """The same model with its denominators written to the shared folder, and its series counted.

        For a model that is used more than once; otherwise every use computes
        the rolling quantile again.
        """
        denominators = cut_lineage(self.denominators)
        return SeriesNormaliserModel(self.covariates, self.target, self.bounds, denominators, key_sizes(denominators))

    def with_denominator(self, df: DataFrame) -> DataFrame:
        return self._with_stats(df, last_denominator(self.denominators)).drop("last_denominator")

    def _with_stats(self, df: DataFrame, stats: DataFrame) -> DataFrame:
        """``denominator`` of the hour, else the last one, and the per-series ``stats``."""
        matched = df.join(self.denominators, [SERIES, TS], "left")
        filled = F.coalesce("denominator", "last_denominator")
        return attach(matched, stats, sizes=self.sizes).withColumn("denominator", filled)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.scale(dataset).drop("denominator")

    def scale(self, dataset: DataFrame, as_is: Sequence[str] = ()) -> DataFrame:
        """Scaled columns and the ``denominator`` of each row; ``as_is`` columns pass unscaled."""
        passed = {SERIES, TS, *as_is}
        derived = [c for c in target_columns(dataset.columns, self.target) if c not in passed]
        scaled = [c for c in self.covariates if c in dataset.columns]
        stats = self.bounds.join(last_denominator(self.denominators), SERIES, "full_outer")
        wide = self._with_stats(dataset, stats)

        def column(c):
            out = F.col(f"`{c}`")
            if c in scaled:
                out = min_max(c, F.col(f"{c}_min"), F.col(f"{c}_max"))
            return (F.try_divide(out, F.col("denominator")) if c in derived else out).alias(c)

        return wide.select(*[column(c) for c in dataset.columns], "denominator")

    def transform_y(self, df: DataFrame, y: str) -> DataFrame:
        divided = F.try_divide(F.col(y), F.col("denominator"))
        return self._replace(df, y, divided)

    def inverse_transform_y(self, df: DataFrame, y: str) -> DataFrame:
        return self._replace(df, y, F.col(y) * F.col("denominator"))

    def _replace(self, df, y, value):
        wide = self.with_denominator(df)
        return wide.select(*[value.alias(c) if c == y else c for c in df.columns])
