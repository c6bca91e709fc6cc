"""Inputs of the registered queries, built from the given tables.

Each view has a Spark builder and the SQL of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotide import SERIES, TS
from heliotide.operators.align import hourly_mean, hour_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark, folder, series: str = "event_type", value: str = "y") -> DataFrame:
    """Raw records: one series per event type."""
    events = table(spark, folder, "events")
    return events.select(F.col(series).cast("string").alias(SERIES), TS, F.col("value").alias(value))


def prod(spark, folder) -> DataFrame:
    """Hourly series with real gaps."""
    return hourly_mean(records(spark, folder), ["y"])


PROD = "prod AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS y FROM events GROUP BY 1, 2)"


def half(spark, folder, odd: bool) -> DataFrame:
    """Hourly means over the users with odd or even number; the halves have different gaps."""
    events = table(spark, folder, "events").where((F.col("user_id") % 2 == 1) == F.lit(odd))
    name = "b" if odd else "a"
    return hourly_mean(events.select(F.col("event_type").alias(SERIES), TS, F.col("value").alias(name)), [name])


HALVES = """
a AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS a FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2),
b AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS b FROM events WHERE user_id % 2 = 1 GROUP BY 1, 2)"""


def both_halves(spark, folder) -> DataFrame:
    events = table(spark, folder, "events")
    odd = F.col("user_id") % 2 == 1
    split = events.select(
        F.col("event_type").alias(SERIES), TS,
        F.when(~odd, F.col("value")).alias("a"), F.when(odd, F.col("value")).alias("b"),
    )
    return split.groupBy(SERIES, hour_of(TS).alias(TS)).agg(F.avg("a").alias("a"), F.avg("b").alias("b")).dropna()


BOTH = """
ab AS (SELECT series_id, ts, a, b FROM (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
         avg(CASE WHEN user_id % 2 = 0 THEN value END) AS a, avg(CASE WHEN user_id % 2 = 1 THEN value END) AS b
  FROM events GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL)"""


def gridded(spark, folder) -> DataFrame:
    """Hourly series with a row for every hour; absent hours are missing values."""
    from heliotide.operators.align import fill_hour_grid

    return fill_hour_grid(prod(spark, folder))


GRID = PROD + """,
span AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM prod GROUP BY 1),
hours AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span),
grid AS (SELECT h.series_id, h.ts, p.y FROM hours h LEFT JOIN prod p ON p.series_id = h.series_id AND p.ts = h.ts)"""


def weather(spark, folder) -> DataFrame:
    """Hourly value per point; point 13 is central."""
    events = table(spark, folder, "events")
    point = (F.col("user_id") % 14).cast("int").alias("point_id")
    return events.groupBy(hour_of(TS).alias(TS), point).agg(F.avg("value").alias("v"))


WEATHER = "weather AS (SELECT date_trunc('hour', ts) AS ts, CAST(user_id % 14 AS INTEGER) AS point_id, avg(value) AS v FROM events GROUP BY 1, 2)"


def registry(spark, folder) -> DataFrame:
    """Commissioning records: region, day, technology, power."""
    orders, customer, nation = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        F.col("n_regionkey").alias("region"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        F.col("o_orderpriority").alias("technology"), F.col("o_totalprice").alias("power"),
    )


DAILY_POWER = """
daily AS (
  SELECT CAST(n_regionkey AS VARCHAR) AS series_id, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS power
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderpriority = '5-LOW'
  GROUP BY 1, 2)"""


def sites(spark, folder) -> DataFrame:
    customer = table(spark, folder, "customer")
    return customer.select(
        F.col("c_nationkey").alias("dept"), (F.col("c_custkey") % 90).cast("double").alias("lat"),
        (F.col("c_custkey") % 180).cast("double").alias("lon"), F.abs("c_acctbal").alias("weight"),
    )
