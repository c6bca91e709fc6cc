"""Distribution, correlation and seasonality of series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotide import SERIES, TS
from heliotide.functions.calendar import ZONE, wall_clock
from heliotide.operators.ordered import attach, number_rows, over_rows, spread_chunks
from heliotide.operators.quantiles import exact_quantiles, with_average_rank

#: Rows of a chunk whose lag products one call sums.
LAG_CHUNK_ROWS = 1 << 16


def distribution_shape(df: DataFrame, value: str, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, and the Jarque-Bera test.

    Jarque-Bera uses population moments; its p-value is that of a chi-square
    with two degrees of freedom.
    """
    moments = df.groupBy(*keys).agg(
        F.count(value).cast("double").alias("n"),
        F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"),
    )
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    skew = F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)
    kurt = F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3))
    jb = n / 6 * (g1 * g1 + g2 * g2 / 4)
    return moments.select(
        *keys, F.col("n").cast("bigint").alias("n"),
        F.when(n > 2, skew).alias("skewness"), F.when(n > 3, kurt).alias("kurtosis"),
        jb.alias("jarque_bera"), F.exp(-jb / 2).alias("p_value"),
    )


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, pearson)`` for every ordered pair, in one aggregate."""
    return _pair_table(df, {c: c for c in columns}, "pearson")


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, spearman)`` over rows complete in all columns.

    Equal rows are merged first. Each column is cut into ranges by its values;
    the rows in a range and those in the ranges before give the ranks, counted
    per distinct value, so a value held by most rows forms no task of its own.
    The merged rows take the ranks of one column after the other, and a value
    gives way to its rank.
    """
    names = [f"_v{i}" for i in range(len(columns))]
    known = df.select([F.col(f"`{c}`").cast("double").alias(v) for c, v in zip(columns, names)]).dropna()
    # said of every column here, it is not added to single ones, and all of them read one exchange
    known = known.where(" AND ".join(f"{v} IS NOT NULL" for v in names)) if names else known
    ranked = rows = known.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    for i, v in enumerate(names):
        ranked = with_average_rank(ranked, v, f"_rank{i}", "_n", of=rows).drop(v)
    return _pair_table(ranked, {c: f"_rank{i}" for i, c in enumerate(columns)}, "spearman", "_n")


def correlation_difference(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson, Spearman and their difference per pair."""
    joined = pearson(df, columns).join(spearman(df, columns), ["a", "b"])
    return joined.withColumn("difference", F.col("pearson") - F.col("spearman"))


def _pair_table(df: DataFrame, columns: dict[str, str], name: str, weight: str | None = None) -> DataFrame:
    labels = list(columns)
    pairs = [(i, j) for i in range(len(labels)) for j in range(i + 1, len(labels))]

    def corr(x: Column, y: Column) -> Column:
        if weight is None:
            return F.corr(x, y)
        w = F.col(weight)
        n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
        cov = F.sum(w * x * y) - sx * sy / n
        return F.try_divide(cov, F.sqrt((F.sum(w * x * x) - sx * sx / n) * (F.sum(w * y * y) - sy * sy / n)))

    values = df.agg(*[
        corr(F.col(columns[labels[i]]), F.col(columns[labels[j]])).alias(f"c{i}_{j}") for i, j in pairs
    ])
    one = F.lit(1.0)

    def line(i, j):
        value = one if i == j else F.col(f"c{min(i, j)}_{max(i, j)}")
        return F.struct(F.lit(labels[i]).alias("a"), F.lit(labels[j]).alias("b"), value.alias(name))

    every = [line(i, j) for i in range(len(labels)) for j in range(len(labels))]
    return values.select(F.inline(F.array(*every)))


def histogram(df: DataFrame, value: str, bins: int = 20, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Equal-width bins between the group's minimum and maximum, the last one closed (A10).

    ``density`` integrates to 1 per group.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    bounds = known.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_total")
    )
    # counted per value first: the join sees each value once per group
    placed = attach(known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), bounds, keys, "inner")
    width = (F.col("_hi") - F.col("_lo")) / bins
    bucket = F.least(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width)), F.lit(bins - 1))
    counted = placed.groupBy(*keys, F.coalesce(bucket, F.lit(0)).alias("bin")).agg(
        F.sum("_c").alias("n"), F.max("_total").alias("_total"),
        F.max("_lo").alias("_lo"), F.max(width).alias("_width"),
    )
    return counted.select(
        *keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_width")).alias("low"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_width")).alias("high"), "n",
        F.try_divide(F.col("n"), F.col("_total") * F.col("_width")).alias("density"),
    )


def box_summary(df: DataFrame, value: str, keys: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Box-plot numbers per group: quartiles, whiskers and rows outside them (A10)."""
    box = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    x, reach = F.col(value), factor * (F.col("q3") - F.col("q1"))
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    rows = attach(df.select(*keys, value).where(x.isNotNull()), box, keys, "inner")
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outside"),
    )


def line_fit(df: DataFrame, y: str, x: str, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Least-squares line of ``y`` on ``x``."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def _centred(df: DataFrame, values: Sequence[str]) -> DataFrame:
    means = df.groupBy(SERIES).agg(*[F.avg(v).alias(f"_m_{v}") for v in values])
    joined = attach(df.select(SERIES, TS, *values), means)
    return joined.select(SERIES, TS, *[(F.col(v) - F.col(f"_m_{v}")).alias(v) for v in values])


def _lag_sums(
    df: DataFrame, fixed: str, moved: Sequence[str], lags: Sequence[int], chunk_rows: int = LAG_CHUNK_ROWS
) -> DataFrame:
    """``(series_id, name, lag, total)``: sum over rows t of ``fixed[t] * name[t + lag]``, for each of ``moved``.

    A chunk of rows, with the few rows beyond its edges that the lags reach, gives
    one sum per lag; only these are added up. Missing values count nothing, and a
    lag that no two rows of a series are apart has no row.
    """
    back, ahead = max(0, -min(lags)), max(0, max(lags))
    names = list(dict.fromkeys([fixed, *moved]))
    # without the times: those of pandas end in the year 2262
    spread = spread_chunks(number_rows(df.select(SERIES, TS, *names)).drop(TS), back, ahead, chunk_rows)

    def products(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        own = np.flatnonzero(part["pos"].to_numpy() // chunk_rows == part["_chunk"].iloc[0])
        first, last = own[0], own[-1] + 1
        x = part[fixed].fillna(0.0).to_numpy(dtype=float)
        out = []
        for name in moved:
            y = part[name].fillna(0.0).to_numpy(dtype=float)
            for lag in lags:
                a, b = max(first, -lag), min(last, len(y) - lag)
                if a < b:
                    out.append((name, lag, float(x[a:b] @ y[a + lag : b + lag])))
        sums = pd.DataFrame(out, columns=["name", "lag", "total"])
        sums.insert(0, SERIES, part[SERIES].iloc[0])
        return sums

    kind = df.schema[SERIES].dataType.simpleString()
    parts = spread.groupBy(SERIES, "_chunk").applyInPandas(products, f"{SERIES} {kind}, name string, lag int, total double")
    return parts.groupBy(SERIES, "name", "lag").agg(F.sum("total").alias("total"))


def autocorrelation(df: DataFrame, value: str, lags: int = 96) -> DataFrame:
    """``(series_id, lag, acf)`` for lags 0..``lags`` by row.

    Missing values count as the mean; fill them first if that is not wanted.
    """
    sums = _lag_sums(_centred(df, [value]), value, [value], range(-lags, 1)).select(SERIES, (-F.col("lag")).alias("lag"), "total")
    variance = sums.where("lag = 0").select(SERIES, F.col("total").alias("_p0"))
    return sums.join(variance, SERIES).select(SERIES, "lag", F.try_divide("total", "_p0").alias("acf"))


def partial_autocorrelation(acf: DataFrame) -> DataFrame:
    """``(series_id, lag, pacf)`` from the result of :func:`autocorrelation`.

    Durbin-Levinson recursion on the unadjusted autocorrelations, as a fold over
    the ``lags + 1`` values of a series; NULL from where it is not defined.
    """
    lagged = F.array_sort(F.collect_list(F.struct("lag", "acf")))
    series = acf.groupBy(SERIES).agg(F.transform(lagged, lambda x: x["acf"]).alias("_rho"))

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        past = F.reverse(F.slice("_rho", F.lit(2), k - 1))
        known = F.aggregate(F.zip_with(phi, past, lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
        reflection = F.try_divide(F.element_at("_rho", k + 1) - known, state["error"])
        # a list of one element, so that the reflection is computed once
        return F.transform(F.array(reflection), lambda r: F.struct(
            F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - r * b), F.array(r)).alias("phi"),
            (state["error"] * (1 - r * r)).alias("error"),
            F.concat(state["out"], F.array(r)).alias("out"),
        ))[0]

    none = F.array().cast("array<double>")
    start = F.struct(none.alias("phi"), F.lit(1.0).alias("error"), F.array(F.lit(1.0)).alias("out"))
    steps = F.when(F.size("_rho") > 1, F.sequence(F.lit(1), F.size("_rho") - 1)).otherwise(F.array().cast("array<int>"))
    found = series.select(SERIES, F.aggregate(steps, start, step, lambda state: state["out"]).alias("_pacf"))
    return found.select(SERIES, F.posexplode("_pacf").alias("lag", "pacf"))


def cross_correlation(df: DataFrame, covariates: Sequence[str], target: str, lags: int = 72) -> DataFrame:
    """``(series_id, covariate, lag, ccf)``: covariate ``lag`` rows ahead against the target.

    Unadjusted, population deviations, lags 0..``lags - 1``.
    """
    values = list(dict.fromkeys([*covariates, target]))
    centred = _centred(df, values).fillna(0.0, values)
    sums = _lag_sums(centred, target, list(covariates), range(lags))
    spreads = centred.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_pop(target).alias("_sy"),
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in covariates]), F.array(*[F.stddev_pop(c) for c in covariates])
        ).alias("_sx"),
    )
    scale = F.col("_n") * F.col("_sy") * F.col("_sx")[F.col("name")]
    return sums.join(spreads, SERIES).select(
        SERIES, F.col("name").alias("covariate"), "lag", F.try_divide("total", scale).alias("ccf")
    )


def decompose_additive(df: DataFrame, value: str, period: int = 24, zone: str = ZONE) -> DataFrame:
    """Trend, seasonal part by hour of day (by the clock of ``zone``), remainder.

    Trend is the centred moving mean whose two end rows weigh half; it is
    missing for half a period at both ends. The seasonal part averages to zero.
    """
    half = period // 2

    def build(w):
        left, right = w.rowsBetween(-half, half - 1), w.rowsBetween(-half + 1, half)
        full = F.count(value).over(w.rowsBetween(-half, half)) == period + 1
        return {"trend": F.when(full, (F.avg(value).over(left) + F.avg(value).over(right)) / 2)}

    trended = over_rows(df.select(SERIES, TS, value), build, back=half, ahead=half)
    phase = trended.withColumn("_hour", F.hour(wall_clock(trended, TS, zone)) % period)
    means = phase.groupBy(SERIES, "_hour").agg(F.avg(F.col(value) - F.col("trend")).alias("_raw"))
    level = means.groupBy(SERIES).agg(F.avg("_raw").alias("_level"))
    seasonal = means.join(level, SERIES).select(SERIES, "_hour", (F.col("_raw") - F.col("_level")).alias("seasonal"))
    joined = attach(phase, seasonal, [SERIES, "_hour"])
    return joined.select(
        SERIES, TS, value, "trend", "seasonal",
        (F.col(value) - F.col("trend") - F.col("seasonal")).alias("remainder"),
    )
