"""The feature tables as the jobs build them, and the stored quantile."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registered import query, r, rounded
from heliotide import SERIES, TS
from heliotide.operators.align import hour_of
from heliotide.plans import feature_tables, jobs
from heliotide.session import shared_dir

CONFIG = feature_tables.FeatureConfig(
    target="y", variables=("v",), past_features=("y",), past_lags=(1, 24), past_windows=(6,),
    forecast_leads=(1, 12), forecast_deltas=(1,),
)
#: The past weather ends where the forecast goes on.
PAST_END = "2024-01-26 00:00:00"


def responses(spark, folder, odd: bool):
    """One response per series, point and hour; a series lacks its central point now and then."""
    events = v.table(spark, folder, "events")
    half = events.where((F.col("user_id") % 2 == 1) == F.lit(odd))
    if not odd:
        half = half.where(F.col("ts") < F.lit(PAST_END).cast("timestamp_ntz"))
    point = (F.floor(F.col("user_id") / 2) % 14).cast("int").alias("point_id")
    hourly = half.groupBy(F.col("event_type").alias(SERIES), point, hour_of(TS).alias("start")).agg(F.avg("value").cast("float").alias("v"))
    end = F.col("start") + F.expr("INTERVAL 1 HOUR")
    return hourly.select(SERIES, "point_id", "start", end.alias("end"), F.lit(3600).alias("step_s"), F.create_map(F.lit("v"), F.array("v")).alias("vars"))


def _weather_sql(name: str, odd: int, limit: str = "") -> str:
    return f"""
{name}_points AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, (user_id // 2) % 14 AS point_id,
  CAST(CAST(avg(value) AS FLOAT) AS DOUBLE) AS v FROM events WHERE user_id % 2 = {odd} {limit} GROUP BY 1, 2, 3),
{name} AS (SELECT series_id, ts, max(v) FILTER (WHERE point_id = 13) AS v,
  round_even(max(v) FILTER (WHERE point_id <> 13) - min(v) FILTER (WHERE point_id <> 13), 4) AS v_delta_minmax,
  round_even(stddev_samp(v) FILTER (WHERE point_id <> 13), 4) AS v_std FROM {name}_points GROUP BY 1, 2)"""


WEATHER_COLUMNS = ["v", "v_delta_minmax", "v_std"]
PAST_COLUMNS = ["y", "y_lag_t-1", "y_lag_t-24", "y_ma_6", "y_volatility_6", "y_ramp_6"]
LEAD_COLUMNS = [f"{c}_forecast_{k}" for c in WEATHER_COLUMNS for k in ("t+1", "t+12", "delta_t+1_t")]
TIME_SQL = """round(sin(2 * pi() * month(ts) / 12), 5) AS month_sin, round(cos(2 * pi() * month(ts) / 12), 5) AS month_cos,
  round(sin(2 * pi() * hour(ts) / 24), 5) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 5) AS hour_cos"""
PAST_SQL = """lag(y, 1) OVER w AS "y_lag_t-1", lag(y, 24) OVER w AS "y_lag_t-24", avg(y) OVER w6 AS y_ma_6,
  stddev_samp(y) OVER w6 AS y_volatility_6, lag(y, 1) OVER w - lag(y, 7) OVER w AS y_ramp_6"""
LEAD_SQL = ", ".join(
    f'lead({c}_forecast, 1) OVER w AS "{c}_forecast_t+1", lead({c}_forecast, 12) OVER w AS "{c}_forecast_t+12", '
    f'lead({c}_forecast, 1) OVER w - {c}_forecast AS "{c}_forecast_delta_t+1_t"' for c in WEATHER_COLUMNS
)
WINDOWS = """WINDOW w AS (PARTITION BY series_id ORDER BY ts),
  w6 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"""
SOURCES = f"""{v.PROD},
{_weather_sql("past_all", 0, f"AND ts < TIMESTAMP '{PAST_END}'")},
{_weather_sql("ahead_all", 1)},
span AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM prod GROUP BY 1),
past AS (SELECT p.* FROM past_all p JOIN span USING (series_id) WHERE ts BETWEEN lo AND hi)"""
RENAMED = ", ".join(f"{c} AS {c}_forecast" for c in WEATHER_COLUMNS)
BEHIND = f"behind AS (SELECT past.*, y, {PAST_SQL} FROM past JOIN prod USING (series_id, ts) {WINDOWS})"
COMPUTED = [*WEATHER_COLUMNS, *PAST_COLUMNS, *LEAD_COLUMNS]
ROUNDED = ", ".join(r(f'"{c}"', c) for c in COMPUTED)


def inputs(spark, folder):
    records = v.records(spark, folder)
    return (
        feature_tables.production_table(records, CONFIG),
        feature_tables.weather_table(responses(spark, folder, False), CONFIG),
        feature_tables.weather_table(responses(spark, folder, True), CONFIG),
    )


@query("inference_feature_table", f"""
WITH {SOURCES},
ahead AS (SELECT series_id, ts, {RENAMED} FROM ahead_all JOIN span USING (series_id) WHERE ts BETWEEN lo AND hi + INTERVAL 47 HOUR),
{BEHIND}, leads AS (SELECT series_id, ts, {LEAD_SQL} FROM ahead {WINDOWS}),
edges AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM past GROUP BY 1),
j AS (SELECT * FROM leads LEFT JOIN behind USING (series_id, ts))
SELECT j.series_id, ts, {ROUNDED}, {TIME_SQL} FROM j JOIN edges USING (series_id) WHERE ts BETWEEN lo AND hi""")
def _(spark, folder):
    return rounded(feature_tables.inference_table(*inputs(spark, folder), CONFIG), *COMPUTED)


@query("training_feature_table", f"""
WITH {SOURCES}, ahead AS (SELECT series_id, ts, {RENAMED} FROM ahead_all),
{BEHIND}, leads AS (SELECT series_id, ts, {LEAD_SQL} FROM ahead {WINDOWS})
SELECT series_id, ts, {ROUNDED}, {TIME_SQL} FROM behind JOIN leads USING (series_id, ts)""")
def _(spark, folder):
    return rounded(feature_tables.training_table(*inputs(spark, folder), CONFIG), *COMPUTED)


@query("training_feature_table_joined_first", f"""
WITH {SOURCES}, ahead AS (SELECT series_id, ts, {RENAMED} FROM ahead_all),
base AS (SELECT * FROM past JOIN ahead USING (series_id, ts) JOIN prod USING (series_id, ts)),
f AS (SELECT *, {PAST_SQL}, {LEAD_SQL} FROM base {WINDOWS})
SELECT series_id, ts, {ROUNDED}, {TIME_SQL} FROM f""")
def _(spark, folder):
    return rounded(feature_tables.training_table(*inputs(spark, folder), CONFIG, leads_first=False), *COMPUTED)


@query("refreshed_quantile", f"""
WITH prod AS (SELECT o_orderpriority AS series_id, o_orderdate AS ts, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2),
m AS (SELECT series_id, max(ts) AS hi FROM prod GROUP BY 1)
SELECT prod.series_id, {r('quantile_cont(y, 0.99)', 'p99_value')} FROM prod JOIN m USING (series_id) WHERE ts > hi - INTERVAL 90 DAY GROUP BY 1""")
def _(spark, folder):
    """The quantile job over 90 days of a series of 2 400 days, through its table."""
    orders = v.table(spark, folder, "orders")
    records = orders.select(F.col("o_orderpriority").alias(SERIES), F.col("o_orderdate").alias(TS), F.col("o_totalprice").alias("y"))
    stored = jobs.refresh_quantile(records, jobs.Layout(shared_dir(spark)), CONFIG, hours=None)
    return rounded(stored.select(SERIES, "p99_value"), "p99_value")
