"""Landing files: production, weather and coordinates.

Files replace the network calls of a live feed; whatever collects them writes
one file per page or response.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliotide import TS
from heliotide.functions.calendar import parse_instant
from heliotide.sources import schemas
from heliotide.sources.tables import path_exists


def _project(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return df.select(*columns) if columns else df


_BROKEN = "_broken"


def _parsed(texts: DataFrame, page: Column) -> DataFrame:
    """``file, page, results`` per page; ``results`` is NULL where the page is not a readable payload."""
    schema = f"{schemas.PRODUCTION_PAYLOAD}, {_BROKEN} string"
    read = F.from_json("page", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    pages = texts.select("file", page.alias("page")).where(F.trim("page") != "")
    return pages.withColumn("_p", read).select(
        "file", "page", F.when(F.col(f"_p.{_BROKEN}").isNull(), F.col("_p.results")).alias("results")
    )


def production_payloads(spark: SparkSession, path: str, layout: str = "pages", glob: str | None = None) -> DataFrame:
    """JSON pages ``{"results": [...]}`` as ``file, page, results``, one row per page.

    ``layout="pages"``: a file holds one page, which may run over several lines,
    or several pages one after another, each beginning on a line of its own;
    such a file is read as a whole. ``layout="lines"``: one page per line; large
    files are split.
    """
    if layout not in ("pages", "lines"):
        raise ValueError(f"unknown layout {layout}")
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    texts = reader.text(path, wholetext=layout == "pages").select(F.col("_metadata.file_path").alias("file"), "value")
    if layout == "lines":
        return _parsed(texts, F.col("value"))
    # Between two objects of one text there is always a comma, so a line break alone ends a page.
    return _parsed(texts, F.explode(F.split("value", r"(?<=\})\s*\n\s*(?=\{)")))


def payload_report(payloads: DataFrame) -> DataFrame:
    """Per file: pages, pages that gave nothing, records. What a reader skips is counted here."""
    return payloads.groupBy("file").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("results").isNull()).alias("skipped_pages"),
        F.sum(F.coalesce(F.size("results"), F.lit(0))).alias("records"),
    )


def _records(payloads: DataFrame) -> DataFrame:
    return payloads.where(F.col("results").isNotNull()).select(F.inline("results"))


def _stem(file: str) -> Column:
    return F.regexp_replace(F.col(file), r"\.[^./]*$", "")


def read_production(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, kind: str | None = None, layout: str = "pages"
) -> DataFrame:
    """Production records from JSON payloads ``{"results": [...]}`` or parquet.

    Without ``kind`` both may lie in one folder. JSON comes first: a parquet
    file of the same name is the fallback, read only where the JSON file gave no
    readable page.
    """
    parquet_reader = spark.read.schema(schemas.PRODUCTION)
    if kind == "json":
        return _project(_records(production_payloads(spark, path, layout)), columns)
    if kind == "parquet":
        return _project(parquet_reader.parquet(path), columns)
    payloads = production_payloads(spark, path, layout, "*.json")
    flat = parquet_reader.option("pathGlobFilter", "*.parquet").parquet(path)
    done = payloads.where(F.col("results").isNotNull()).select(_stem("file").alias("_stem")).distinct()
    fallback = flat.withColumn("_stem", _stem("_metadata.file_path")).join(done, "_stem", "left_anti").drop("_stem")
    return _project(_records(payloads).unionByName(fallback), columns)


def read_production_pages(
    spark: SparkSession, folder: str, columns: Sequence[str] | None = None, layout: str = "pages"
) -> DataFrame:
    """All pages of all files of a folder; an absent folder gives an empty table.

    A page that is no readable JSON yields no record, as a failed call does;
    ``payload_report`` over ``production_payloads`` counts such pages per file.
    """
    if not path_exists(spark, folder):
        return _project(spark.createDataFrame([], schemas.PRODUCTION), columns)
    return _project(_records(production_payloads(spark, folder, layout)), columns)


def select_production(
    df: DataFrame, region: int | str, since: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Source-side filter and projection (S3).

    ``since`` is an instant (ISO text; without offset it is UTC). Instants are
    compared, not texts; the plain ``date`` column, a day wider, is what parquet
    scans are given to skip files by.
    """
    kept = df.where(F.col("code_insee_region") == str(region))
    if since:
        start = datetime.fromisoformat(since)
        start = start if start.tzinfo else start.replace(tzinfo=timezone.utc)
        if "date" in df.columns:
            kept = kept.where(F.col("date").isNull() | (F.col("date") >= (start - timedelta(days=1)).date().isoformat()))
        kept = kept.where(parse_instant("date_heure") >= F.lit(start))
    return _project(kept, columns)


def hourly_input(
    df: DataFrame, target: str = "solaire", series: str = "code_insee_region", unreadable: str = "raise"
) -> DataFrame:
    """``(series_id, ts, target)`` from production records; NaN becomes missing.

    A time that cannot be read fails the query, or with ``unreadable="skip"``
    leaves its record out; ``unreadable_times`` counts such records.
    """
    ts = parse_instant("date_heure")
    if unreadable == "raise":
        text = F.coalesce(F.col("date_heure"), F.lit("(none)"))
        ts = F.coalesce(ts, F.raise_error(F.concat(F.lit("unreadable time: "), text)).cast("timestamp"))
    elif unreadable != "skip":
        raise ValueError(f"unknown rule {unreadable}")
    hourly = df.select(F.col(series).alias("series_id"), ts.alias(TS), nan_to_null(target).alias(target))
    return hourly.where(F.col(TS).isNotNull()) if unreadable == "skip" else hourly


def unreadable_times(df: DataFrame, series: str = "code_insee_region") -> DataFrame:
    """Per series: records, and how many of them have a time that cannot be read."""
    return df.groupBy(F.col(series).alias("series_id")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(parse_instant("date_heure").isNull()).alias("unreadable")
    )


def nan_to_null(column: str) -> Column:
    return F.when(~F.isnan(column), F.col(column))


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Weather responses, one JSON object per line."""
    return spark.read.schema(schemas.WEATHER_RESPONSE).json(path)


def expand_weather(
    responses: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("point_id",)
) -> DataFrame:
    """Array payloads -> one row per point and hour.

    The grid runs from ``start`` (included) to ``end`` (excluded) in steps of
    ``step_s`` seconds. Points whose response is missing have no rows.
    """
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("step_s").cast("decimal(18,6)"))
    times = F.when(
        F.col("end") > F.col("start"), F.sequence(F.col("start"), F.col("end") - step, step)
    ).otherwise(F.array())
    numbered = responses.select(*keys, "vars", F.posexplode(times).alias("_i", TS))
    return numbered.select(
        *keys, TS,
        *[_known(F.get(F.try_element_at("vars", F.lit(v)), F.col("_i"))).alias(v) for v in variables],
    )


def _known(x: Column) -> Column:
    return F.when(~F.isnan(x), x.cast("double"))


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Coordinates table with WKT points; fails when it has no row, or one that is no point."""
    points = wkt_points(spark.read.schema(schemas.COORDINATES).parquet(path))
    seen = points.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lon").isNull() | F.col("lat").isNull()).alias("bad")).first()
    if not seen["n"] or seen["bad"]:
        raise ValueError(f"{seen['n']} coordinates in {path}, {seen['bad']} of them not a point")
    return points


def wkt_points(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """``POINT (lon lat)`` -> ``lon, lat``; other text gives NULL."""
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"

    def part(k):
        return F.regexp_extract(geometry, pattern, k).try_cast("double")

    return df.select(*[c for c in df.columns if c != geometry], part(1).alias("lon"), part(2).alias("lat"))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ";", index: str = TS
) -> DataFrame:
    """CSV with a header whose first column is the time index."""
    df = spark.read.option("sep", sep).option("header", True).schema(schema).csv(path)
    return df.withColumnRenamed(df.columns[0], index)
