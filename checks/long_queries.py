"""Features over one series that is long enough to cross blocks and chunks, with windows of full size."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.feature_queries import FORECAST, PAST, PAST_SQL, PAST_W, W
from checks.registered import query, r, rounded, rs
from checks.serving_queries import _rolled
from heliotide import SERIES, TS
from heliotide.operators import features, normalize, quality

#: Every line of every order is one hour of a single series; numbers of absent lines are gaps.
LONG = """prod AS (SELECT 'all' AS series_id, TIMESTAMP '1970-01-01' + to_hours(l_orderkey * 8 + l_linenumber) AS ts,
  max(CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice END) AS y FROM lineitem GROUP BY 1, 2)"""
FULL_WINDOW = 2160


def long_series(spark, folder):
    lines = v.table(spark, folder, "lineitem")
    hours = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    # by whole days: hours alone pass 32 bits where keys are large
    days, rest = F.floor(hours / 24).cast("int"), F.pmod(hours, F.lit(24)).cast("int")
    ts = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(days, rest, F.lit(0), F.lit(0).cast("decimal(18,6)"))
    price = F.max(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice"))).alias("y")
    return lines.groupBy(F.lit("all").alias(SERIES), ts.alias(TS)).agg(price)


@query("past_features_long", f"""
WITH {LONG}, f AS (SELECT series_id, ts, y, {PAST_SQL} FROM prod {PAST_W})
SELECT series_id, ts, {rs(["y", *PAST], 7)} FROM f""")
def _(spark, folder):
    return rounded(features.add_past_features(long_series(spark, folder), ["y"], [1, 24], [6, 24]), "y", *PAST, places=7)


@query("forecast_features_long", f"""
WITH {LONG}, f AS (SELECT series_id, ts, y, lead(y, 1) OVER w AS "y_t+1", lead(y, 12) OVER w AS "y_t+12",
  lead(y, 1) OVER w - y AS "y_delta_t+1_t", lead(y, 24) OVER w - y AS "y_delta_t+24_t" FROM prod {W})
SELECT series_id, ts, {rs(['y', *FORECAST], 4)} FROM f""")
def _(spark, folder):
    return rounded(features.add_forecast_features(long_series(spark, folder), ["y"], [1, 12], [1, 24]), "y", *FORECAST, places=7)


@query("rolling_quantile_long", f"""
WITH {LONG}, {_rolled(FULL_WINDOW, 24)},
den AS (SELECT series_id, ts, y, CAST(first_value(q IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS FLOAT) AS d FROM q)
SELECT series_id, ts, {r('y', 'y')}, {r('d', 'denominator', 1)} FROM den""")
def _(spark, folder):
    rolled = normalize.rolling_quantile(long_series(spark, folder), "y", window=FULL_WINDOW)
    return rounded(rounded(rolled, "y"), "denominator", places=1)


@query("outliers_long", f"""
WITH {LONG}, s AS (SELECT series_id, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, avg(y) AS m, stddev_samp(y) AS sd FROM prod GROUP BY 1)
SELECT prod.series_id, ts, coalesce(y <= q1 - 0.5 * (q3 - q1) OR y >= q3 + 0.5 * (q3 - q1), false) AS iqr_outlier,
  coalesce(abs((y - m) / sd) > 1.5, false) AS z_outlier FROM prod JOIN s USING (series_id)""")
def _(spark, folder):
    return quality.flag_outliers(long_series(spark, folder), "y", 0.5, 1.5).select(SERIES, TS, "iqr_outlier", "z_outlier")
