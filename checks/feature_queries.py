"""Alignment, features, windows and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registered import query, r, rounded, rs
from heliotide import SERIES, TS
from heliotide.functions import calendar
from heliotide.operators import align, features, ordered, shape, split

W = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"

# --- alignment ------------------------------------------------------------


@query("hourly_mean", f"WITH {v.PROD} SELECT series_id, ts, {r('y', 'y')} FROM prod WHERE y IS NOT NULL")
def _(spark, folder):
    return rounded(v.prod(spark, folder), "y")


@query("hourly_mean_per_user", f"""
SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('hour', ts) AS ts, {r('avg(value)', 'y')}
FROM events GROUP BY 1, 2""")
def _(spark, folder):
    return rounded(align.hourly_mean(v.records(spark, folder, "user_id"), ["y"]), "y")


@query("region_and_time_range", """
SELECT event_id, event_type AS code_insee_region, ts, value FROM events
WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
def _(spark, folder):
    events = v.table(spark, folder, "events").withColumnRenamed("event_type", "code_insee_region")
    kept = align.between_times(align.select_region(events, "view"), "2024-01-05 00:00:00", "2024-01-20 12:00:00")
    return kept.select("event_id", "code_insee_region", "ts", "value")


@query("clip_to_reference", f"""
WITH {v.HALVES}, bounds AS (SELECT series_id, min(ts) AS lo, max(ts) + INTERVAL 47 HOUR AS hi FROM a
  WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-19 23:00:00' GROUP BY 1)
SELECT b.series_id, b.ts, {r('b', 'b')} FROM b JOIN bounds ON bounds.series_id = b.series_id AND b.ts BETWEEN lo AND hi""")
def _(spark, folder):
    reference = align.between_times(v.half(spark, folder, False), "2024-01-08 00:00:00", "2024-01-19 23:00:00")
    return rounded(align.clip_to(v.half(spark, folder, True), reference, 47), "b")


def _join(how, sql_how):
    @query(f"join_{how}", f"""
    WITH {v.HALVES} SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(a.ts, b.ts) AS ts,
      {r('a', 'a')}, {r('b', 'b')} FROM a {sql_how} JOIN b ON a.series_id = b.series_id AND a.ts = b.ts""")
    def _(spark, folder):
        joined = align.join_hourly(v.half(spark, folder, False), v.half(spark, folder, True), how)
        return rounded(joined, "a", "b")


_join("inner", "INNER")
_join("right", "RIGHT")
_join("full_outer", "FULL")


@query("index_mismatch", f"""
WITH {v.HALVES} SELECT coalesce(a.series_id, b.series_id) AS series_id,
  count(*) FILTER (WHERE b.ts IS NULL) AS only_left, count(*) FILTER (WHERE a.ts IS NULL) AS only_right,
  count(*) FILTER (WHERE a.ts IS NOT NULL AND b.ts IS NOT NULL) AS both
FROM a FULL JOIN b ON a.series_id = b.series_id AND a.ts = b.ts GROUP BY 1""")
def _(spark, folder):
    return align.index_mismatch(v.half(spark, folder, False), v.half(spark, folder, True))


@query("hour_grid", f"WITH {v.GRID} SELECT series_id, ts, {r('y', 'y')} FROM grid")
def _(spark, folder):
    return rounded(v.gridded(spark, folder), "y")


@query("zero_filled_grid", f"WITH {v.GRID} SELECT series_id, ts, {r('coalesce(y, 0)', 'y')} FROM grid")
def _(spark, folder):
    return rounded(shape.fill_zero(v.gridded(spark, folder), ["y"]), "y")


@query("rows_without_missing", f"WITH {v.GRID} SELECT series_id, ts, {r('y', 'y')} FROM grid WHERE y IS NOT NULL")
def _(spark, folder):
    return rounded(shape.drop_missing(v.gridded(spark, folder), ["y"]), "y")


@query("forward_fill", f"""
WITH {v.GRID} SELECT series_id, ts, {r('last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING)', 'y')}
FROM grid""")
def _(spark, folder):
    return rounded(align.forward_fill(v.gridded(spark, folder), ["y"]), "y")


INTERPOLATED = f"""
WITH {v.GRID},
placed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM grid),
sides AS (SELECT *,
  last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS p,
  last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pi,
  first_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni
  FROM placed)
SELECT series_id, ts, {r('CASE WHEN y IS NOT NULL THEN y WHEN i - pi <= 1 THEN coalesce(p + (nv - p) * (i - pi) / (ni - pi), p) END', 'y')} FROM sides"""


@query("interpolate_short_gaps", INTERPOLATED)
def _(spark, folder):
    return rounded(align.interpolate(v.gridded(spark, folder), ["y"], limit=1), "y")


@query("interpolate_three", INTERPOLATED.replace("i - pi <= 1", "i - pi <= 3"))
def _(spark, folder):
    return rounded(align.interpolate(v.gridded(spark, folder), ["y"]), "y")


# --- names and rows -------------------------------------------------------

@query("renamed_columns", f"""
WITH {v.BOTH} SELECT series_id, ts, {r('a', 'v_forecast')}, {r('b', 'v_run_130_forecast')} FROM ab""")
def _(spark, folder):
    wide = shape.rename_cast(v.both_halves(spark, folder), {"a": ("v_run_13", "double"), "b": ("v_run_130", "double")})
    wide = wide.withColumn("other", F.lit(1))
    kept = shape.add_suffix(shape.keep_matching(shape.strip_run(wide, 13), ["v"]))
    return rounded(kept, "v_forecast", "v_run_130_forecast")


@query("drop_unshifted", f"WITH {v.BOTH} SELECT series_id, ts, {r('a', 'a')} FROM ab")
def _(spark, folder):
    return rounded(shape.drop_unshifted(v.both_halves(spark, folder), ["b"]), "a")


@query("rename_and_cast", """
SELECT CAST(c_custkey AS VARCHAR) AS site, CAST(c_acctbal AS FLOAT) AS balance, c_name FROM customer""")
def _(spark, folder):
    customer = v.table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_name")
    return shape.rename_cast(customer, {"c_custkey": ("site", "string"), "c_acctbal": ("balance", "float")})


@query("first_date_as_key", "SELECT ts, event_id, value FROM events")
def _(spark, folder):
    events = v.table(spark, folder, "events")
    runs = events.select(F.col("ts").alias("date_run_0"), "event_id", "value", F.col("ts").alias("date_run_1"))
    return shape.first_date_as_key(runs)


@query("positive_rows", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def _(spark, folder):
    return shape.positive(v.table(spark, folder, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


@query("last_duplicate", """
SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, max(event_id) AS event_id, arg_max(value, event_id) AS value
FROM events GROUP BY 1, 2""")
def _(spark, folder):
    events = v.table(spark, folder, "events")
    rows = events.select(F.col("event_type").alias(SERIES), align.hour_of("ts").alias(TS), "event_id", "value")
    return shape.last_duplicate(rows, "event_id")


@query("encoder_decoder_split", """
WITH names AS (SELECT 'g' || (c_nationkey % 5) || CASE c_custkey % 4 WHEN 0 THEN '_forecast_t+1' WHEN 1 THEN '_month_sin' WHEN 2 THEN '_hour_cos' ELSE '_lag_t-1' END AS feature FROM customer),
u AS (SELECT DISTINCT feature FROM names)
SELECT feature, feature NOT LIKE '%forecast%' AS encoder,
  (feature LIKE '%forecast%' OR feature LIKE '%month%' OR feature LIKE '%hour%') AS decoder FROM u""")
def _(spark, folder):
    kind = F.expr("CASE c_custkey % 4 WHEN 0 THEN '_forecast_t+1' WHEN 1 THEN '_month_sin' WHEN 2 THEN '_hour_cos' ELSE '_lag_t-1' END")
    customer = v.table(spark, folder, "customer")
    names = customer.select(F.concat(F.lit("g"), (F.col("c_nationkey") % 5).cast("string"), kind).alias("feature")).distinct()
    # names are the columns of one table, hence few
    encoder, decoder = shape.encoder_decoder([row.feature for row in names.collect()])
    return names.select("feature", F.col("feature").isin(encoder).alias("encoder"), F.col("feature").isin(decoder).alias("decoder"))


@query("feature_union", "SELECT DISTINCT p_brand AS feature FROM part UNION SELECT 'hour_sin' UNION SELECT 'hour_cos'")
def _(spark, folder):
    part = v.table(spark, folder, "part").select(F.col("p_brand").alias("feature"))
    return shape.feature_union(part, ["hour_sin", "hour_cos"])


@query("sorted_sample", f"WITH {v.PROD} SELECT series_id, ts, {r('y', 'y')} FROM prod ORDER BY ts, series_id LIMIT 240")
def _(spark, folder):
    return rounded(v.prod(spark, folder).orderBy(TS, SERIES).limit(240), "y")


# --- features -------------------------------------------------------------

PAST = ["y_lag_t-1", "y_lag_t-24", "y_ma_6", "y_volatility_6", "y_ramp_6", "y_ma_24", "y_volatility_24", "y_ramp_24"]
PAST_SQL = """
  lag(y, 1) OVER w AS "y_lag_t-1", lag(y, 24) OVER w AS "y_lag_t-24",
  avg(y) OVER w6 AS y_ma_6, stddev_samp(y) OVER w6 AS y_volatility_6, lag(y, 1) OVER w - lag(y, 7) OVER w AS y_ramp_6,
  avg(y) OVER w24 AS y_ma_24, stddev_samp(y) OVER w24 AS y_volatility_24, lag(y, 1) OVER w - lag(y, 25) OVER w AS y_ramp_24"""
PAST_W = W + """,
  w6 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
  w24 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"""


def past(spark, folder, grid="rows"):
    return features.add_past_features(v.prod(spark, folder), ["y"], [1, 24], [6, 24], grid)


@query("past_features", f"""
WITH {v.PROD}, f AS (SELECT series_id, ts, y, {PAST_SQL} FROM prod {PAST_W})
SELECT series_id, ts, {rs(['y', *PAST], 8)} FROM f""")
def _(spark, folder):
    return rounded(past(spark, folder), "y", *PAST, places=8)


@query("past_features_by_hour", f"""
WITH {v.GRID}, f AS (SELECT series_id, ts, y, {PAST_SQL} FROM grid {PAST_W})
SELECT series_id, ts, {rs(['y', *PAST], 8)} FROM f WHERE y IS NOT NULL""")
def _(spark, folder):
    return rounded(past(spark, folder, "hours"), "y", *PAST, places=8)


@query("past_features_per_user", f"""
WITH prod AS (SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS y FROM events GROUP BY 1, 2),
f AS (SELECT series_id, ts, y, {PAST_SQL} FROM prod {PAST_W})
SELECT series_id, ts, {rs(['y', *PAST], 8)} FROM f""")
def _(spark, folder):
    hourly = align.hourly_mean(v.records(spark, folder, "user_id"), ["y"])
    return rounded(features.add_past_features(hourly, ["y"], [1, 24], [6, 24]), "y", *PAST, places=8)


@query("latest_feature_row", f"""
WITH {v.PROD}, f AS (SELECT series_id, ts, y, {PAST_SQL} FROM prod {PAST_W}),
t AS (SELECT *, round(sin(2 * pi() * month(ts) / 12), 5) AS month_sin, round(cos(2 * pi() * month(ts) / 12), 5) AS month_cos,
  round(sin(2 * pi() * hour(ts) / 24), 5) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 5) AS hour_cos,
  row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS n FROM f)
SELECT series_id, ts, {rs(['y', *PAST], 8)}, month_sin, month_cos, hour_sin, hour_cos FROM t WHERE n = 1""")
def latest_feature_row(spark, folder):
    table = features.add_time_features(past(spark, folder), {"month": 12, "hour": 24})
    return rounded(shape.last_row(table), "y", *PAST, places=8)


FORECAST = ["y_t+1", "y_t+12", "y_delta_t+1_t", "y_delta_t+24_t"]


@query("forecast_features", f"""
WITH {v.PROD}, f AS (SELECT series_id, ts, y, lead(y, 1) OVER w AS "y_t+1", lead(y, 12) OVER w AS "y_t+12",
  lead(y, 1) OVER w - y AS "y_delta_t+1_t", lead(y, 24) OVER w - y AS "y_delta_t+24_t" FROM prod {W})
SELECT series_id, ts, {rs(['y', *FORECAST])} FROM f""")
def _(spark, folder):
    return rounded(features.add_forecast_features(v.prod(spark, folder), ["y"], [1, 12], [1, 24]), "y", *FORECAST)


@query("cyclic_features", """
SELECT event_id, ts, round(sin(2 * pi() * month(ts) / 12), 5) AS month_sin, round(cos(2 * pi() * month(ts) / 12), 5) AS month_cos,
  round(sin(2 * pi() * hour(ts) / 24), 5) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 5) AS hour_cos,
  round(sin(2 * pi() * day(ts) / 365), 5) AS day_sin, round(cos(2 * pi() * day(ts) / 365), 5) AS day_cos FROM events""")
def _(spark, folder):
    events = v.table(spark, folder, "events").select("event_id", "ts")
    return calendar.add_cyclic(events, {"month": 12, "hour": 24, "day": 365})


@query("calendar_parts", """
SELECT event_id, ts, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
  CAST(month(ts) AS INTEGER) AS month, CAST(year(ts) AS INTEGER) AS year FROM events""")
def _(spark, folder):
    return calendar.add_calendar(v.table(spark, folder, "events").select("event_id", "ts"))


@query("calendar_of_instants", """
SELECT event_id, CAST(hour(w) AS INTEGER) AS hour, CAST(isodow(w) - 1 AS INTEGER) AS weekday,
       CAST(month(w) AS INTEGER) AS month, CAST(year(w) AS INTEGER) AS year
FROM (SELECT event_id, timezone('Europe/Paris', timezone('UTC', ts)) AS w FROM events)""")
def _(spark, folder):
    events = v.table(spark, folder, "events")
    # zone-less UTC times as instants, whatever the session's zone
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)")
    instants = events.select("event_id", F.timestamp_micros(micros).alias("ts"))
    return calendar.add_calendar(instants).drop("ts")


@query("local_time_and_text", """
SELECT event_id, ts + INTERVAL 30 HOUR AS later, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris' AS local,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events""")
def _(spark, folder):
    events = v.table(spark, folder, "events")
    return events.select(
        "event_id", calendar.add_hours("ts", 30).alias("later"), calendar.to_local("ts").alias("local"),
        calendar.as_text("ts").alias("text"),
    )


@query("seasonal_difference", f"""
WITH {v.PROD}, d AS (SELECT series_id, ts, y, y - lag(y, 24) OVER w AS y_diff_24 FROM prod {W})
SELECT series_id, ts, {rs(['y', 'y_diff_24'])} FROM d WHERE y_diff_24 IS NOT NULL""")
def _(spark, folder):
    return rounded(features.seasonal_difference(v.prod(spark, folder), "y"), "y", "y_diff_24")


@query("long_rolling_mean", f"""
WITH {v.PROD}, d AS (SELECT series_id, ts, CASE WHEN count(y) OVER f = 640 THEN avg(y) OVER f END AS y_mean_640 FROM prod
  WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS 639 PRECEDING))
SELECT series_id, ts, {rs(['y_mean_640'])} FROM d""")
def _(spark, folder):
    return rounded(features.rolling_mean(v.prod(spark, folder), "y").drop("y"), "y_mean_640")


@query("targets_per_horizon", f"""
WITH {v.PROD} SELECT series_id, ts, {r('y', 'y')}, {r('lead(y, 1) OVER w', 'y_h1')}, {r('lead(y, 12) OVER w', 'y_h12')}, {r('lead(y, 24) OVER w', 'y_h24')}
FROM prod {W}""")
def _(spark, folder):
    return rounded(features.add_targets(v.prod(spark, folder), "y", [1, 12, 24]), "y", "y_h1", "y_h12", "y_h24")


@query("targets_long", f"""
WITH {v.PROD}, n AS (SELECT *, row_number() OVER w AS i FROM prod {W})
SELECT a.series_id, a.ts, CAST(b.i - a.i AS INTEGER) AS horizon, {r('b.y', 'label')}
FROM n a JOIN n b ON a.series_id = b.series_id AND b.i - a.i BETWEEN 1 AND 24""")
def _(spark, folder):
    return rounded(features.targets_long(v.prod(spark, folder), "y", range(1, 25)), "label")


@query("aligned_to_target", f"""
WITH {v.PROD}, d AS (SELECT series_id, ts, y, lead(y, 6) OVER w AS label FROM prod {W})
SELECT series_id, ts, {rs(['y', 'label'])} FROM d WHERE label IS NOT NULL""")
def _(spark, folder):
    return rounded(features.align_to_target(v.prod(spark, folder), "y", 6), "y", "label")


@query("sliding_sequences", f"""
WITH {v.BOTH}, f AS (SELECT series_id, ts AS start, row_number() OVER w AS i, count(*) OVER s AS n,
  sum(a) OVER p AS past_a, sum(b) OVER p AS past_b, sum(a) OVER q AS future_a, sum(b) OVER q AS future_y,
  lead(b, 71) OVER w AS last_y FROM ab {W},
  s AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 71 FOLLOWING),
  p AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING),
  q AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 48 FOLLOWING AND 71 FOLLOWING))
SELECT series_id, start, 48 AS n_past, 24 AS n_future, {rs(['past_a', 'past_b', 'future_a', 'future_y', 'last_y'])}
FROM f WHERE n = 72 AND (i - 1) % 5 = 0""")
def _(spark, folder):
    seq = features.sequences(v.both_halves(spark, folder), ["a"], ["a"], "b", stride=5)

    def total(column, i=None):
        item = (lambda acc, x: acc + x[i]) if i is not None else (lambda acc, x: acc + x)
        return F.aggregate(column, F.lit(0.0), item)

    out = seq.select(
        SERIES, "start", F.size("x_past").alias("n_past"), F.size("x_future").alias("n_future"),
        total("x_past", 0).alias("past_a"), total("x_past", 1).alias("past_b"),
        total("x_future", 0).alias("future_a"), total("y").alias("future_y"), F.element_at("y", -1).alias("last_y"),
    )
    return rounded(out, "past_a", "past_b", "future_a", "future_y", "last_y")


@query("standardised", f"""
WITH {v.PROD} SELECT series_id, ts, {r('(y - avg(y) OVER s) / stddev_samp(y) OVER s', 'y')} FROM prod WINDOW s AS (PARTITION BY series_id)""")
def _(spark, folder):
    return rounded(features.standardise(v.prod(spark, folder), ["y"]), "y")


GAINS = """
gains AS (SELECT l_returnflag AS horizon, unnest(['quantity', 'discount', 'tax', 'line']) AS feature,
  unnest([sum(l_quantity), sum(l_discount) * 100, sum(l_tax) * 200, sum(l_linenumber)]) AS gain FROM lineitem GROUP BY 1),
shares AS (SELECT horizon, feature, gain, sum(gain) OVER (PARTITION BY horizon ORDER BY gain DESC, feature ROWS UNBOUNDED PRECEDING)
  / sum(gain) OVER (PARTITION BY horizon) AS share FROM gains)"""


def gains(spark, folder):
    sums = v.table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("horizon")).agg(
        F.sum("l_quantity").alias("quantity"), (F.sum("l_discount") * 100).alias("discount"),
        (F.sum("l_tax") * 200).alias("tax"), F.sum("l_linenumber").cast("double").alias("line"),
    )
    return sums.unpivot("horizon", ["quantity", "discount", "tax", "line"], "feature", "gain")


@query("pareto_selection", f"WITH {GAINS} SELECT horizon, feature, {rs(['gain', 'share'], 3)} FROM shares WHERE share < 0.95")
def _(spark, folder):
    return rounded(features.pareto_select(gains(spark, folder)), "gain", "share", places=3)


@query("pareto_selection_closed", f"WITH {GAINS} SELECT horizon, feature, {rs(['gain', 'share'], 3)} FROM shares WHERE share <= 0.9")
def _(spark, folder):
    return rounded(features.pareto_select(gains(spark, folder), 0.9, inclusive=True), "gain", "share", places=3)


# --- positions and splits -------------------------------------------------

@query("row_positions", f"""
WITH {v.PROD} SELECT series_id, ts, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n_rows FROM prod {W}""")
def _(spark, folder):
    return ordered.number_rows(v.prod(spark, folder), total="n_rows").select(SERIES, TS, "pos", "n_rows")


NUMBERED = f"{v.PROD}, n AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM prod {W})"


@query("train_test_split", f"""
WITH {NUMBERED} SELECT series_id, ts, {r('y', 'y')},
  CASE WHEN pos >= n - ceil(n * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS role FROM n""")
def _(spark, folder):
    return rounded(split.ordered_split(v.prod(spark, folder), "y"), "y")


@query("validation_split", f"""
WITH {NUMBERED} SELECT series_id, ts, {r('y', 'y')},
  CASE WHEN pos >= floor(n * CAST(0.75 AS DOUBLE)) THEN 'validation' ELSE 'train' END AS role FROM n""")
def _(spark, folder):
    return rounded(split.validation_split(v.prod(spark, folder)), "y")


@query("expanding_folds", f"""
WITH {NUMBERED}, k AS (SELECT *, CAST(unnest(range(1, 6)) AS INTEGER) AS fold, n // 6 AS size FROM n)
SELECT series_id, ts, {r('y', 'y')}, fold, CASE WHEN pos >= n - (6 - fold) * size THEN 'test' ELSE 'train' END AS role
FROM k WHERE pos < n - (6 - fold) * size + size""")
def _(spark, folder):
    return rounded(split.expanding_folds(v.prod(spark, folder)), "y")
