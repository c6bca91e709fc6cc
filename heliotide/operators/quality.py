"""Contracts, outlier flags, gap reports and dataset summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliotide import SERIES, TS
from heliotide.operators.ordered import BLOCK, KeySizes, attach, block_window, with_block_context
from heliotide.operators.quantiles import exact_quantiles, summaries


@dataclass(frozen=True)
class Range:
    """Allowed values of one numeric column."""

    column: str
    low: float
    high: float
    nullable: bool = False


# Accepted ranges of the central point, the spread (max - min)
# and the standard deviation of each weather variable, and its nullability.
WEATHER_RANGES = {
    "temperature_2m": ((-30, 55), (0, 30), (0, 20), False),
    "relative_humidity_2m": ((0, 100), (0, 100), (0, 75), False),
    "precipitation": ((0, 250), (0, 150), (0, 50), True),
    "surface_pressure": ((800, 1200), (0, 200), (0, 50), False),
    "cloud_cover": ((0, 100), (0, 100), (0, 50), False),
    "wind_speed_10m": ((0, 300), (0, 200), (0, 50), False),
    "wind_direction_10m": ((0, 360), (0, 360), (0, 180), False),
    "global_tilted_irradiance": ((0, 1500), (0, 1500), (0, 500), True),
}


def production_contract(target: str = "solaire") -> list[Range]:
    return [Range(target, 0, 10000, True)]


def weather_contract(suffix: str = "") -> list[Range]:
    """Central, spread and deviation columns of every weather variable."""
    rules = []
    for name, (central, spread, deviation, nullable) in WEATHER_RANGES.items():
        rules.append(Range(f"{name}{suffix}", *central, nullable))
        rules.append(Range(f"{name}_delta_minmax{suffix}", *spread, nullable))
        rules.append(Range(f"{name}_std{suffix}", *deviation, nullable))
    return rules


def _violations(df: DataFrame, contract: Sequence[Range]) -> dict[tuple[str, str], Column]:
    """(column, rule) -> condition, for the columns that exist."""
    found = {}
    for rule in contract:
        if rule.column not in df.columns:
            continue
        raw = F.col(rule.column)
        number = raw.try_cast("double")
        found[rule.column, "type"] = raw.isNotNull() & number.isNull()
        if not rule.nullable:
            found[rule.column, "not_null"] = raw.isNull()
        found[rule.column, "min"] = number < rule.low
        found[rule.column, "max"] = number > rule.high
    return found


def contract_report(
    df: DataFrame, contract: Sequence[Range], keys: Sequence[str] = (SERIES, TS)
) -> DataFrame:
    """``(column, rule, n_bad)`` for every rule, also those that hold (Q1).

    Ranges are counted in one pass; uniqueness of the key needs one grouping.
    ``missing`` and ``unexpected`` columns count 1.
    """
    checks = _violations(df, contract)
    counts = df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(checks.values())])
    lines = [
        F.struct(F.lit(col).alias("column"), F.lit(rule).alias("rule"), F.col(f"n{i}").alias("n_bad"))
        for i, (col, rule) in enumerate(checks)
    ]
    names = [r.column for r in contract]
    strict = [(c, "missing") for c in [*keys, *names] if c not in df.columns]
    strict += [(c, "unexpected") for c in df.columns if c not in names and c not in keys]
    lines += [
        F.struct(F.lit(col).alias("column"), F.lit(rule).alias("rule"), F.lit(1).cast("bigint").alias("n_bad"))
        for col, rule in strict
    ]
    report = counts.select(F.inline(F.array(*lines)))
    if any(k not in df.columns for k in keys):
        return report
    copies = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_bad"))
    return report.unionByName(
        copies.select(F.lit(",".join(keys)).alias("column"), F.lit("unique").alias("rule"), "n_bad")
    )


def contract_violations(df: DataFrame, contract: Sequence[Range]) -> DataFrame:
    """Rows that break a range rule, with ``broken`` naming the rules (Q1)."""
    marks = [F.when(c, F.lit(f"{col}:{rule}")) for (col, rule), c in _violations(df, contract).items()]
    return df.withColumn("broken", F.array_compact(F.array(*marks))).where(F.size("broken") > 0)


def coerce(df: DataFrame, contract: Sequence[Range]) -> DataFrame:
    """Contract columns as doubles, values that cannot be read as NULL (Q1)."""
    wanted = {r.column for r in contract}
    return df.select([F.col(c).try_cast("double").alias(c) if c in wanted else c for c in df.columns])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pass ``df`` on, or fail when a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def value_counts(df: DataFrame, target: str) -> DataFrame:
    """One row: ``n_rows, n_values, usable`` of the target."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(target).alias("n_values"))
    return counted.withColumn("usable", F.col("n_values") > 0)


def check_has_values(df: DataFrame, target: str) -> DataFrame:
    """Pass ``df`` on, or fail when it has no row or only missing targets.

    Runs one job: a single row with a value is enough to stop.
    """
    if df.where(F.col(target).isNotNull()).isEmpty():
        raise ValueError(f"no row has a value in {target!r}")
    return df


def flag_outliers(
    df: DataFrame, value: str | Sequence[str], factor: float = 1.5, z_limit: float = 3.0, sizes: KeySizes | None = None
) -> DataFrame:
    """Add ``iqr_outlier``, ``z_outlier`` and their conjunction ``outlier`` (Q2-Q4).

    Quartile fences are closed; the z-score uses the sample deviation. Both
    are per series over its whole history. A missing value is no outlier.
    Several columns are judged from one pass over their values; their flags are
    named ``{column}_iqr_outlier`` and so on.
    """
    several = not isinstance(value, str)
    values = list(value) if several else [value]
    stats = ("q1", "q3", "mean", "std")
    if several:
        cells = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"`{c}`").cast("double").alias("_x")) for i, c in enumerate(values)])
        long = summaries(df.select(SERIES, F.inline(cells)), [SERIES, "_i"], "_x", [0.25, 0.75], ["q1", "q3"])
        known = long.groupBy(SERIES).agg(*[
            F.max(F.when(F.col("_i") == i, F.col(s))).alias(f"_{s}{i}") for i in range(len(values)) for s in stats
        ])
    else:
        quartiles = exact_quantiles(df, [SERIES], value, [0.25, 0.75], ["_q10", "_q30"])
        moments = df.groupBy(SERIES).agg(F.avg(value).alias("_mean0"), F.stddev_samp(value).alias("_std0"))
        known = quartiles.join(moments, SERIES)
    joined, no, flags = attach(df, known, sizes=sizes), F.lit(False), []
    for i, c in enumerate(values):
        x, q1, q3 = F.col(f"`{c}`"), F.col(f"_q1{i}"), F.col(f"_q3{i}")
        reach, prefix = factor * (q3 - q1), f"{c}_" if several else ""
        iqr = F.coalesce((x <= q1 - reach) | (x >= q3 + reach), no)
        z = F.coalesce(F.abs(F.try_divide(x - F.col(f"_mean{i}"), F.col(f"_std{i}"))) > z_limit, no)
        flags += [iqr.alias(f"{prefix}iqr_outlier"), z.alias(f"{prefix}z_outlier"), (iqr & z).alias(f"{prefix}outlier")]
    return joined.select(*df.columns, *flags)


def missing_runs(df: DataFrame, value: str | Sequence[str], max_gap: int = 3) -> DataFrame:
    """Runs of more than ``max_gap`` missing rows on an hourly grid (Q5).

    ``run_no`` counts all runs of the series, reported or not. ``open`` marks
    a run that reaches the end of the series. Several columns are looked at in
    one pass; the result then has a ``column``.
    """
    if isinstance(value, str):
        keys, marked = [SERIES], df.select(SERIES, TS, F.col(f"`{value}`").isNull().alias("_missing"))
    else:
        keys = [SERIES, "column"]
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").isNull().alias("_missing")) for c in value])
        marked = df.select(SERIES, TS, F.inline(cells))
    neighbours = with_block_context(
        marked, before_last={"_prev": F.max_by("_missing", TS)}, after_first={"_next": F.min_by("_missing", TS)}, keys=keys
    )
    missing, window = F.col("_missing"), block_window(keys)
    before = F.coalesce(F.lag("_missing", 1).over(window), F.col("_prev"), F.lit(False))
    starts = neighbours.select(
        *keys, TS, "_missing", BLOCK, (missing & ~before).cast("int").alias("_starts"),
        F.coalesce(F.lead("_missing", 1).over(window), F.col("_next")).isNull().alias("_final"),
    )
    context = with_block_context(starts, before_sum={"_before": F.sum("_starts")}, keys=keys)
    run_no = F.col("_before") + F.sum("_starts").over(window)
    runs = (
        context.withColumn("run_no", run_no)
        .where("_missing")
        .groupBy(*keys, "run_no")
        .agg(
            F.min(TS).alias("start"), F.max(TS).alias("end"),
            F.count(F.lit(1)).alias("n_missing"), F.bool_or("_final").alias("open"),
        )
    )
    return runs.where(F.col("n_missing") > max_gap)


def summary(df: DataFrame, ts: str = TS) -> DataFrame:
    """One row: rows, columns, start, end and missing cells (Q8)."""
    cells = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
        F.min(ts).alias("start"), F.max(ts).alias("end"), cells.alias("n_nulls"),
    )


def column_profile(df: DataFrame, percentiles: bool = False) -> DataFrame:
    """Per column: type, missing values, and for numbers mean, std, min, max (Q9); with ``percentiles`` the quartiles too.

    One scan either way.
    """
    if percentiles:
        return _profile_of_cells(df)
    aggs, lines = [], []
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        numeric = isinstance(field.dataType, T.NumericType)
        aggs.append(F.count_if(c.isNull()).alias(f"null{i}"))
        if numeric:
            aggs += [
                F.count(c).alias(f"n{i}"), F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"std{i}"),
                F.min(c).cast("double").alias(f"min{i}"), F.max(c).cast("double").alias(f"max{i}"),
            ]
        none = F.lit(None).cast("double")
        lines.append(F.struct(
            F.lit(field.name).alias("column"), F.lit(field.dataType.simpleString()).alias("dtype"),
            F.col(f"null{i}").alias("n_null"),
            *[(F.col(f"{s}{i}") if numeric else none).alias(s) for s in ("mean", "std", "min", "max")],
        ))
    return df.agg(*aggs).select(F.inline(F.array(*lines)))


def _profile_of_cells(df: DataFrame) -> DataFrame:
    """The profile with quartiles, everything from one count of (column, value).

    Of columns that are no numbers only missing values are counted.
    """
    cells, kinds = [], []
    for i, field in enumerate(df.schema.fields):
        c, numeric = F.col(f"`{field.name}`"), isinstance(field.dataType, T.NumericType)
        x = c.cast("double") if numeric else F.when(c.isNotNull(), F.lit(0.0))
        cells.append(F.struct(F.lit(i).alias("_i"), x.alias("_x")))
        kinds.append((i, field.name, field.dataType.simpleString(), numeric))
    found = summaries(df.select(F.inline(F.array(*cells))), ["_i"], "_x", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], few_keys=True)
    listed = df.sparkSession.createDataFrame(kinds, "_i int, column string, dtype string, _number boolean")
    return listed.join(found, "_i", "left").select(
        "column", "dtype", F.coalesce("n_null", F.lit(0)).alias("n_null"),
        *[F.when(F.col("_number"), F.col(s)).alias(s) for s in ("mean", "std", "min", "max", "p25", "p50", "p75")],
    )


def type_counts(df: DataFrame) -> DataFrame:
    """Number of columns per type (Q9); from the schema alone."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    listed = df.sparkSession.createDataFrame(rows, "column string, dtype string")
    return listed.groupBy("dtype").agg(F.count("column").alias("n_columns"))


def duplicate_share(df: DataFrame) -> DataFrame:
    """One row: ``n_rows, n_duplicates, duplicate_pct`` over whole rows (Q9)."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return counted.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("n_duplicates"),
    ).withColumn("duplicate_pct", F.try_divide(F.col("n_duplicates") * 100.0, F.col("n_rows")))
