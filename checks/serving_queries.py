"""Sources and sinks, normalisation, evaluation, publishing, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.feature_queries import GAINS, gains, past
from checks.registered import query, r, rounded, rs
from heliotide import SERIES, TS
from heliotide.functions import scaling
from heliotide.operators import evaluate, features, normalize, publish, shape
from heliotide.session import cut_lineage, shared_dir
from heliotide.sources import readers, schemas, tables

W = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"

# --- sources and sinks ----------------------------------------------------


def production_records(spark, folder):
    events = v.table(spark, folder, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return events.select(
        "event_id", F.col("event_type").alias("code_insee_region"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.date_format("ts", "HH:mm").alias("heure"), text.alias("date_heure"), F.col("value").alias("solaire"),
    )


@query("production_pages", "SELECT event_type AS series_id, epoch_us(ts) AS micros, value AS solaire FROM events")
def _(spark, folder):
    path = shared_dir(spark)
    fields = ["code_insee_region", "date", "heure", "date_heure", "solaire"]
    # a page holds at most 96 records, as event numbers are unique; a file holds many pages
    pages = production_records(spark, folder).groupBy(F.floor(F.col("event_id") / 96).alias("page")).agg(
        F.collect_list(F.struct(*fields)).alias("results")
    )
    pages.select("results").write.json(path)
    hourly = readers.hourly_input(readers.read_production_pages(spark, path))
    return hourly.select(SERIES, F.unix_micros(TS).alias("micros"), "solaire")


@query("production_json", """
SELECT event_type AS code_insee_region, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS date_heure, value AS solaire
FROM events WHERE event_id % 7 <> 3""")
def _(spark, folder):
    """Files with one page over many lines, files with many pages, broken pages among them."""
    path = shared_dir(spark)
    record = F.to_json(F.struct("code_insee_region", "date", "heure", "date_heure", "solaire"))
    records = production_records(spark, folder)
    broken = F.col("event_id") % 7 == 3
    # a page lists at most 50 records, as event numbers are unique
    page = records.groupBy(F.floor(F.col("event_id") / 350).alias("p"), (F.col("event_id") % 7).alias("k")).agg(
        F.concat(F.lit('{"results": [\n'), F.array_join(F.sort_array(F.collect_list(record)), ",\n"), F.lit("\n]}")).alias("value"),
        F.first(broken).alias("broken"),
    )
    page.select(F.when(F.col("broken"), F.concat(F.lit("{oops "), "value")).otherwise(F.col("value"))).write.text(path)
    return readers.read_production(spark, path, ["code_insee_region", "date_heure", "solaire"], kind="json")


@query("payload_report", """
SELECT count(DISTINCT event_id // 96) AS pages, 0 AS skipped_pages, count(*) AS records FROM events""")
def _(spark, folder):
    path = shared_dir(spark)
    pages = production_records(spark, folder).groupBy(F.floor(F.col("event_id") / 96).alias("page")).agg(
        F.collect_list(F.struct("code_insee_region", "date", "heure", "date_heure", "solaire")).alias("results")
    )
    pages.select("results").write.json(path)
    report = readers.payload_report(readers.production_payloads(spark, path, layout="lines"))
    return report.agg(*[F.sum(c).alias(c) for c in ("pages", "skipped_pages", "records")])


@query("production_parquet", """
SELECT event_type AS code_insee_region, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS date_heure, value AS solaire
FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-15 00:00:00'""")
def _(spark, folder):
    path = shared_dir(spark)
    production_records(spark, folder).drop("event_id").write.parquet(path)
    landed = readers.read_production(spark, path, kind="parquet")
    return readers.select_production(landed, "click", "2024-01-15T00:00:00", ["code_insee_region", "date_heure", "solaire"])


@query("records_from_json_text", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def _(spark, folder):
    events = v.table(spark, folder, "events")
    return events.select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")


@query("weather_arrays_to_hours", f"""
WITH {v.WEATHER}, d AS (SELECT DISTINCT point_id, date_trunc('day', ts) AS day FROM weather),
h AS (SELECT point_id, day + to_hours(CAST(i AS INTEGER)) AS ts FROM d CROSS JOIN (SELECT unnest(range(0, 24)) AS i))
SELECT h.point_id, h.ts, {r('v', 'v')} FROM h LEFT JOIN weather w ON w.point_id = h.point_id AND w.ts = h.ts""")
def _(spark, folder):
    day = F.window(TS, "1 day").start
    slots = [F.max(F.when(F.hour(TS) == i, F.col("v"))).alias(f"h{i}") for i in range(24)]
    daily = v.weather(spark, folder).groupBy("point_id", day.alias("start")).agg(*slots)
    payload = daily.select(
        "point_id", "start", (F.col("start") + F.expr("INTERVAL 24 HOUR")).alias("end"), F.lit(3600).alias("step_s"),
        F.create_map(F.lit("v"), F.array(*[f"h{i}" for i in range(24)])).alias("vars"),
    )
    return rounded(readers.expand_weather(payload, ["v"]), "v")


@query("wkt_points", """
SELECT c_custkey, CAST(c_custkey % 180 AS DOUBLE) / 4 - 20 AS lon, CAST(c_custkey % 90 AS DOUBLE) / 8 - 5 AS lat FROM customer""")
def _(spark, folder):
    key = F.col("c_custkey")
    lon, lat = (key % 180).cast("double") / 4 - 20, (key % 90).cast("double") / 8 - 5
    text = F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))
    return readers.wkt_points(v.table(spark, folder, "customer").select("c_custkey", text.alias("geometry")))


def runs(spark, folder):
    events = v.table(spark, folder, "events")
    return events.select(
        F.col("user_id").cast("string").alias(SERIES), F.col("value").alias("p99_value"), F.col("ts").alias("computed_at")
    )


@query("latest_quantile", "SELECT CAST(user_id AS VARCHAR) AS series_id, arg_max(value, ts) AS p99_value, max(ts) AS computed_at FROM events GROUP BY 1")
def _(spark, folder):
    return tables.latest_quantile(runs(spark, folder))


@query("merge_latest", "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def _(spark, folder):
    events = v.table(spark, folder, "events").select("user_id", "value", "event_id")
    early = events.where("event_id % 2 = 0")
    return tables.merge_latest(early, events.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("upserted_predictions", """
SELECT event_type AS series_id, date_trunc('hour', ts) AS predicted_at, date_trunc('hour', ts) + INTERVAL 1 HOUR AS forecast_horizon,
  arg_max(value, (CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END, event_id)) AS predicted_value FROM events GROUP BY 1, 2, 3""")
def _(spark, folder):
    from heliotide.operators.ordered import last_per_key

    path, keys = shared_dir(spark), list(tables.PREDICTION_KEYS)
    events = v.table(spark, folder, "events").select(
        F.col("event_type").alias(SERIES), F.window(TS, "1 hour").start.alias("predicted_at"), "user_id", "event_id",
        F.col("value").alias("predicted_value"),
    ).withColumn("forecast_horizon", F.col("predicted_at") + F.expr("INTERVAL 1 HOUR"))
    for odd in (0, 1):  # two deliveries, the second corrects the first
        delivered = last_per_key(events.where(F.col("user_id") % 2 == odd), keys, ["event_id"])
        tables.upsert_predictions(delivered.select(*keys, "predicted_value"), path)
    return tables.read_predictions(spark, path)


@query("upserted_quantiles", "SELECT CAST(user_id AS VARCHAR) AS series_id, arg_max(value, ts) AS p99_value, max(ts) AS computed_at FROM events GROUP BY 1")
def _(spark, folder):
    path, every = shared_dir(spark), runs(spark, folder)
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (every.where(F.col("computed_at") < middle), every.where(F.col("computed_at") >= middle)):
        tables.upsert_quantiles(tables.latest_quantile(part), path)
    return tables.read_quantiles(spark, path)


@query("table_round_trip", "SELECT event_id, ts, user_id, event_type, value FROM events")
def _(spark, folder):
    path = shared_dir(spark)
    events = v.table(spark, folder, "events").drop("props")
    tables.write_table(events.where("value < 0"), path)
    tables.write_table(events, path, ["event_type"])
    return tables.read_table(spark, path).select("event_id", "ts", "user_id", "event_type", "value")


@query("training_table_in_local_time", f"""
WITH {v.PROD} SELECT series_id, ts, {r('y', 'y')}, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris' AS ts_local FROM prod""")
def _(spark, folder):
    path = shared_dir(spark)
    tables.write_table(v.prod(spark, folder), path)
    return rounded(tables.load_training_table(spark, path), "y")


@query("csv_round_trip", "SELECT ts, user_id, event_type, value FROM events")
def _(spark, folder):
    path = shared_dir(spark)
    events = v.table(spark, folder, "events").select(F.col("ts").alias("time"), "user_id", "event_type", "value")
    tables.write_csv(events, path, sep=";")
    return readers.read_csv(spark, path, "time timestamp_ntz, user_id bigint, event_type string, value double")


@query("feature_set_table", f"WITH {GAINS} SELECT horizon AS horizon_set, feature FROM shares WHERE share < 0.95")
def _(spark, folder):
    path = shared_dir(spark)
    # as many rows as the models have columns
    chosen = features.pareto_select(gains(spark, folder)).groupBy("horizon").agg(F.collect_list("feature").alias("f")).collect()
    tables.write_feature_sets(spark, {str(row["horizon"]): row["f"] for row in chosen}, path)
    stored = [(name, feature) for name, some in tables.read_feature_sets(spark, path).items() for feature in some]
    return spark.createDataFrame(stored, "horizon_set string, feature string")


# --- normalisation --------------------------------------------------------

@query("recent_quantile", f"""
WITH {v.PROD}, m AS (SELECT series_id, max(ts) AS hi FROM prod GROUP BY 1)
SELECT prod.series_id, {r('quantile_cont(y, 0.99)', 'p99_value')}, max(ts) AS computed_at FROM prod JOIN m ON m.series_id = prod.series_id
WHERE ts > hi - INTERVAL 240 HOUR GROUP BY 1""")
def _(spark, folder):
    return rounded(normalize.recent_quantile(v.prod(spark, folder), "y", days=10), "p99_value")


def _rolled(rows, minimum):
    return f"""q AS (SELECT series_id, ts, y, CASE WHEN count(y) OVER f >= {minimum} THEN quantile_cont(y, 0.99) OVER f END AS q FROM prod
  WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS {rows - 1} PRECEDING))"""


DENOMINATORS = _rolled(240, 24) + """,
den AS (SELECT series_id, ts, y, CAST(first_value(q IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS FLOAT) AS d FROM q)"""


@query("rolling_quantile", f"WITH {v.PROD}, {DENOMINATORS} SELECT series_id, ts, {r('y', 'y')}, {r('d', 'denominator', 3)} FROM den")
def _(spark, folder):
    rolled = normalize.rolling_quantile(v.prod(spark, folder), "y", window=240)
    return rounded(rounded(rolled, "y"), "denominator", places=3)


@query("rolling_quantile_in_chunks", f"WITH {v.PROD}, {DENOMINATORS} SELECT series_id, ts, {r('y', 'y')}, {r('d', 'denominator', 3)} FROM den")
def _(spark, folder):
    rolled = normalize.rolling_quantile(v.prod(spark, folder), "y", window=240, chunk_rows=100)
    return rounded(rounded(rolled, "y"), "denominator", places=3)


@query("rolling_quantile_by_window", f"WITH {v.PROD}, {DENOMINATORS} SELECT series_id, ts, {r('y', 'y')}, {r('d', 'denominator', 3)} FROM den")
def _(spark, folder):
    rolled = normalize.rolling_quantile(v.prod(spark, folder), "y", window=240, fast=False)
    return rounded(rounded(rolled, "y"), "denominator", places=3)


@query("rolling_quantile_strict", f"""
WITH {v.PROD}, {_rolled(480, 480)} SELECT series_id, ts, {r('y', 'y')}, {r('CAST(q AS FLOAT)', 'denominator', 3)} FROM q""")
def _(spark, folder):
    rolled = normalize.rolling_quantile(v.prod(spark, folder), "y", window=480, min_values=480, back_fill=False)
    return rounded(rounded(rolled, "y"), "denominator", places=3)


@query("column_bounds", f"""
WITH {v.BOTH} SELECT series_id, {r('min(a)', 'a_min')}, {r('min(b)', 'b_min')}, {r('max(a)', 'a_max')}, {r('max(b)', 'b_max')} FROM ab GROUP BY 1""")
def _(spark, folder):
    return rounded(normalize.column_bounds(v.both_halves(spark, folder), ["a", "b"]), "a_min", "b_min", "a_max", "b_max")


@query("last_denominator", f"WITH {v.PROD}, {DENOMINATORS} SELECT series_id, {r('arg_max(d, ts)', 'last_denominator', 3)} FROM den GROUP BY 1")
def _(spark, folder):
    rolled = normalize.rolling_quantile(v.prod(spark, folder), "y", window=240)
    return rounded(normalize.last_denominator(rolled), "last_denominator", places=3)


FIRST = "ts < TIMESTAMP '2024-01-21 00:00:00'"
NORMALISED = f"""
WITH {v.BOTH}, prod AS (SELECT series_id, ts, b AS y FROM ab WHERE {FIRST}), {DENOMINATORS},
bounds AS (SELECT series_id, min(a) AS lo, max(a) AS hi FROM ab WHERE {FIRST} GROUP BY 1),
newest AS (SELECT series_id, arg_max(d, ts) AS d FROM den GROUP BY 1),
lagged AS (SELECT series_id, ts, a, b, lag(b, 24) OVER w AS lagged FROM ab {W}),
j AS (SELECT l.*, lo, hi, CAST(coalesce(den.d, newest.d) AS DOUBLE) AS d FROM lagged l JOIN bounds USING (series_id)
  JOIN newest USING (series_id) LEFT JOIN den ON den.series_id = l.series_id AND den.ts = l.ts)"""


def fitted(spark, folder):
    both = v.both_halves(spark, folder)
    first = both.where(F.col(TS) < F.lit("2024-01-21").cast("timestamp_ntz"))
    return both, normalize.SeriesNormaliser(["a"], "b", window=240).fit(first)


@query("normalised_features", NORMALISED + f"""
SELECT series_id, ts, {r('(a - lo) / (hi - lo)', 'a')}, {r('b / d', 'b', 5)}, {r('lagged / d', 'b_lag_t-24', 5)} FROM j""")
def _(spark, folder):
    both, model = fitted(spark, folder)
    table = features.add_past_features(both, ["b"], [24], [])
    return rounded(rounded(model.transform(table), "a"), "b", "b_lag_t-24", places=5)


@query("normalised_target", NORMALISED + f"SELECT series_id, ts, {r('b / d', 'b', 5)} FROM j")
def _(spark, folder):
    both, model = fitted(spark, folder)
    return rounded(model.transform_y(both.drop("a"), "b"), "b", places=5)


@query("denormalised_target", NORMALISED + f"SELECT series_id, ts, {r('a * d', 'a', 2)} FROM j")
def _(spark, folder):
    both, model = fitted(spark, folder)
    return rounded(model.inverse_transform_y(both.drop("b"), "a"), "a", places=2)


@query("min_max_scaled", """
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_returnflag = 'A'),
c AS (SELECT l_returnflag AS series_id, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)
SELECT l_returnflag AS series_id, l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo), 6) AS scaled
FROM lineitem JOIN c ON c.series_id = l_returnflag""")
def _(spark, folder):
    from heliotide.operators.ordered import attach

    lines = v.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias(SERIES), "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    joined = attach(lines, normalize.column_bounds(lines, ["l_extendedprice"]))
    scaled = scaling.min_max("l_extendedprice", F.col("l_extendedprice_min"), F.col("l_extendedprice_max"))
    return rounded(joined.select(SERIES, "l_orderkey", "l_linenumber", scaled.alias("scaled")), "scaled")


@query("sequence_tables", f"""
WITH {v.BOTH}, n AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM ab {W}),
p AS (SELECT *, CASE WHEN pos >= floor(n * CAST(0.75 AS DOUBLE)) THEN 'validation' ELSE 'train' END AS role FROM n),
bounds AS (SELECT series_id, min(a) AS lo, max(a) AS hi FROM p WHERE role = 'train' GROUP BY 1),
s AS (SELECT role, p.series_id, ts AS start, row_number() OVER k AS i, count(*) OVER f AS n_rows, sum((a - lo) / (hi - lo)) OVER q AS future_a
  FROM p JOIN bounds USING (series_id) WINDOW k AS (PARTITION BY role, p.series_id ORDER BY ts),
  f AS (PARTITION BY role, p.series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 71 FOLLOWING),
  q AS (PARTITION BY role, p.series_id ORDER BY ts ROWS BETWEEN 48 FOLLOWING AND 71 FOLLOWING))
SELECT role, series_id, start, {r('future_a', 'future_a')} FROM s WHERE n_rows = 72 AND (i - 1) % 2 = 0""")
def _(spark, folder):
    from heliotide.plans.feature_tables import sequence_tables

    train, validation = sequence_tables(v.both_halves(spark, folder), ["a"], ["a"], ["a"], "b", stride=2, window=240)
    both = train.withColumn("role", F.lit("train")).unionByName(validation.withColumn("role", F.lit("validation")))
    total = F.aggregate("x_future", F.lit(0.0), lambda acc, x: acc + x[0])
    return rounded(both.select("role", SERIES, "start", total.alias("future_a")), "future_a")


# --- evaluation -----------------------------------------------------------

WALK = f"""
{v.PROD}, n AS (SELECT series_id, ts, row_number() OVER w AS origin, count(*) OVER (PARTITION BY series_id) AS n,
  avg(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS ma,
  list(ts) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS target_ts,
  list(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS actual,
  list(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS baseline FROM prod {W}),
o AS (SELECT *, CAST(unnest(range(1, 25)) AS INTEGER) AS h FROM n WHERE origin >= 48 AND origin < n - 24),
walk AS (SELECT series_id, ts AS origin_ts, h AS horizon, target_ts[h] AS target_ts, actual[h] AS actual, baseline[h] AS baseline, ma AS prediction, origin FROM o)"""


@query("walk_forward", f"WITH {WALK} SELECT series_id, origin_ts, horizon, target_ts, {rs(['actual', 'baseline'])} FROM walk")
def _(spark, folder):
    return rounded(evaluate.walk_forward(v.prod(spark, folder), "y"), "actual", "baseline")


@query("walk_forward_with_stride", f"WITH {WALK} SELECT series_id, origin_ts, horizon, target_ts, {rs(['actual', 'baseline'])} FROM walk WHERE (origin - 48) % 6 = 0")
def _(spark, folder):
    return rounded(evaluate.walk_forward(v.prod(spark, folder), "y", stride=6), "actual", "baseline")


def evaluated(spark, folder):
    """Walk-forward table whose prediction is the moving mean at the origin."""
    walk = evaluate.walk_forward(v.prod(spark, folder), "y")
    table = features.add_past_features(v.prod(spark, folder), ["y"], [1], [24])
    each = F.explode(F.sequence(F.lit(1), F.lit(24))).alias("horizon")
    predictions = table.select(SERIES, F.col(TS).alias("origin_ts"), F.col("y_ma_24").alias("prediction"), each)
    return evaluate.join_predictions(walk, predictions)


@query("prediction_coverage", f"""
WITH {WALK} SELECT series_id, horizon, count(*) AS n_actual,
  CAST(count(*) FILTER (WHERE hour(origin_ts) % 2 = 1 OR horizon NOT IN (1, 2, 24)) AS BIGINT) AS n_missing,
  {r('sum(prediction * 2) FILTER (WHERE hour(origin_ts) % 2 = 0 AND horizon IN (1, 2, 24))', 'total', 3)} FROM walk GROUP BY 1, 2""")
def _(spark, folder):
    """Wide predictions of every second origin and three horizons: the others are counted, not dropped."""
    table = features.add_past_features(v.prod(spark, folder), ["y"], [1], [24]).where(F.hour(TS) % 2 == 0)
    wide = table.select(SERIES, TS, F.lit(2.0).alias("denominator"), *[F.col("y_ma_24").alias(f"+{h}h") for h in (1, 2, 24)])
    joined = evaluate.join_predictions(evaluate.walk_forward(v.prod(spark, folder), "y"), evaluate.predictions_by_origin(wide, "denominator"))
    totals = joined.groupBy(SERIES, "horizon").agg(F.sum("prediction").alias("total"))
    return rounded(evaluate.prediction_coverage(joined).join(totals, [SERIES, "horizon"]), "total", places=3)


@query("error_summary", f"""
WITH {WALK} SELECT series_id, count(*) AS n, {r('sqrt(avg((actual - prediction) ** 2))', 'rmse')}, {r('avg(abs(actual - prediction))', 'mae')},
  {r('avg(abs((actual - prediction) / (actual + 1e-6))) * 100', 'mape', 3)} FROM walk GROUP BY 1""")
def _(spark, folder):
    errors = evaluate.error_summary(evaluated(spark, folder), by=[SERIES])
    return rounded(rounded(errors, "rmse", "mae"), "mape", places=3)


@query("skill_per_horizon", f"""
WITH {WALK}, g AS (SELECT series_id, horizon, count(*) AS n, sqrt(avg((actual - prediction) ** 2)) AS rmse, avg(abs(actual - prediction)) AS mae,
  sqrt(avg((actual - baseline) ** 2)) AS rmse_baseline FROM walk GROUP BY GROUPING SETS ((series_id, horizon), (series_id)))
SELECT series_id, horizon, n, {rs(['rmse', 'mae', 'rmse_baseline'])}, {r('1 - rmse / rmse_baseline', 'skill')} FROM g""")
def _(spark, folder):
    return rounded(evaluate.skill_table(evaluated(spark, folder)), "rmse", "mae", "rmse_baseline", "skill")


# --- publishing -----------------------------------------------------------

LONG = f"""
{v.PROD}, f AS (SELECT series_id, ts, lag(y, 1) OVER w AS p1, lag(y, 2) OVER w AS p2, lag(y, 24) OVER w AS p24 FROM prod {W}),
long AS (SELECT series_id, ts AS predicted_at, ts + to_hours(h) AS forecast_horizon, h AS horizon,
  CASE h WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p24 END AS predicted_value FROM f CROSS JOIN (VALUES (1), (2), (24)) t(h))"""


def wide_predictions(spark, folder):
    lagged = features.add_past_features(v.prod(spark, folder), ["y"], [1, 2, 24], [])
    names = {1: "y_lag_t-1", 2: "y_lag_t-2", 24: "y_lag_t-24"}
    return lagged.select(SERIES, TS, *[F.col(f"`{c}`").alias(f"+{h}h") for h, c in names.items()])


@query("melted_predictions", f"WITH {LONG} SELECT series_id, predicted_at, forecast_horizon, {r('predicted_value', 'predicted_value')} FROM long")
def _(spark, folder):
    return rounded(shape.melt_predictions(wide_predictions(spark, folder)), "predicted_value")


@query("pivoted_horizons", f"WITH {LONG} SELECT series_id, predicted_at AS ts, {r('max(predicted_value) FILTER (WHERE horizon = 1)', '+1h')}, "
       f"{r('max(predicted_value) FILTER (WHERE horizon = 2)', '+2h')}, {r('max(predicted_value) FILTER (WHERE horizon = 24)', '+24h')} FROM long GROUP BY 1, 2")
def _(spark, folder):
    wide = wide_predictions(spark, folder)
    long = wide.unpivot([SERIES, TS], ["`+1h`", "`+2h`", "`+24h`"], "label", "predicted_value")
    from heliotide.functions.calendar import horizon_of

    numbered = long.withColumn("horizon", horizon_of("label"))
    return rounded(shape.pivot_horizons(numbered, [1, 2, 24]), "+1h", "+2h", "+24h")


def published(spark, folder):
    return shape.melt_predictions(wide_predictions(spark, folder))


@query("newest_predictions", f"""
WITH {LONG} SELECT series_id, predicted_at, forecast_horizon, {r('predicted_value', 'predicted_value')}
FROM long WHERE predicted_at = (SELECT max(predicted_at) FROM long x WHERE x.series_id = long.series_id)""")
def _(spark, folder):
    return rounded(shape.newest_predictions(published(spark, folder)), "predicted_value")


@query("nested_latest_predictions", f"""
WITH {LONG} SELECT series_id, predicted_at, string_agg(strftime(forecast_horizon, '%Y-%m-%d %H:%M:%S') || '=' || CAST(CAST(floor(predicted_value) AS BIGINT) AS VARCHAR), ';' ORDER BY forecast_horizon) AS predictions
FROM long WHERE predicted_at = (SELECT max(predicted_at) FROM long x WHERE x.series_id = long.series_id) GROUP BY 1, 2""")
def _(spark, folder):
    nested = publish.nested_latest(published(spark, folder))
    text = F.transform("predictions", lambda p: F.concat(
        F.date_format(p["forecast_horizon"], "yyyy-MM-dd HH:mm:ss"), F.lit("="), F.floor(p["predicted_value"]).cast("string")
    ))
    return nested.select(SERIES, "predicted_at", F.array_join(text, ";").alias("predictions"))


@query("rescaled_text_predictions", f"""
WITH {LONG}, q AS (SELECT series_id, arg_max(y, ts) AS q FROM prod GROUP BY 1)
SELECT long.series_id, strftime(predicted_at, '%Y-%m-%d %H:%M:%S') AS predicted_at, strftime(forecast_horizon, '%Y-%m-%d %H:%M:%S') AS forecast_horizon,
  {r('predicted_value * q', 'predicted_value', 10)} FROM long JOIN q ON q.series_id = long.series_id""")
def _(spark, folder):
    factors = v.prod(spark, folder).select(SERIES, F.col("y").alias("p99_value"), F.col(TS).alias("computed_at"))
    scaled = publish.rescale_predictions(published(spark, folder), factors)
    return rounded(publish.with_text_times(scaled), "predicted_value", places=10)


@query("non_negative_values", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, folder):
    return v.table(spark, folder, "customer").select("c_custkey", scaling.non_negative("c_acctbal").alias("c_acctbal"))


@query("horizon_buckets", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS horizon,
  CASE WHEN l_quantity <= 3 THEN 'short' WHEN l_quantity <= 12 THEN 'mid' ELSE 'long' END AS training_set,
  CASE WHEN l_quantity <= 6 THEN 'short' WHEN l_quantity <= 12 THEN 'medium' ELSE 'long' END AS tag FROM lineitem""")
def _(spark, folder):
    lines = v.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("horizon"))
    return lines.select("*", scaling.training_set().alias("training_set"), scaling.horizon_tag().alias("tag"))


# --- models -----------------------------------------------------------------

def model_input(spark, folder):
    """Hourly table with past and time features, target ``y``."""
    table = features.add_past_features(v.prod(spark, folder), ["y"], [1, 24], [6])
    return features.add_time_features(table)


MODEL_FEATURES = ["y_lag_t-1", "y_lag_t-24", "y_ma_6", "y_ramp_6", "hour_sin", "hour_cos"]


@query("selected_feature_gains")
def _(spark, folder):
    from heliotide.learning import boosting

    return boosting.fit_gains(model_input(spark, folder), MODEL_FEATURES, "y", [1, 24], boosting.SMALL_SELECTOR_PARAMS)


@query("trained_model_forecast")
def _(spark, folder):
    from heliotide.learning import boosting, registry

    config = boosting.TrainingConfig.small(horizons=(1, 24), trials=1)
    table = model_input(spark, folder)
    model = boosting.train_horizons(table, MODEL_FEATURES, ["hour_sin", "hour_cos"], "y", config)
    root = shared_dir(spark)
    registry.publish_model(spark, model, root)
    return shape.melt_predictions(registry.load_model(spark, root).predict_wide(table))


@query("training_run_records")
def _(spark, folder):
    from heliotide.learning import boosting, registry

    config = boosting.TrainingConfig.small(horizons=(12,), trials=2)
    model = boosting.train_horizons(model_input(spark, folder), MODEL_FEATURES, [], "y", config)
    path = shared_dir(spark)
    registry.log_run(spark, model, path)
    records = registry.read_runs(spark, path)
    return records.select("horizon", "feature_set", "horizon_tag", "n_features", "rmse")


# Trees of depth 0 predict the mean label, so what is around them can be checked in SQL.
FLAT_RANGES = {"maxDepth": (0, 0, "int"), "stepSize": (0.1, 0.1, "log"), "maxIter": (1, 1, "int"), "minInstancesPerNode": (10, 10, "int"), "maxBins": (32, 32, "int")}
FLAT_SELECTOR = {"maxDepth": 0, "stepSize": 0.1, "maxIter": 1, "minInstancesPerNode": 20}
FLAT_HORIZONS = (1, 24)


def flat_training(spark, folder, folds):
    from heliotide.learning import boosting

    config = boosting.TrainingConfig(
        horizons=FLAT_HORIZONS, folds=folds, trials=1, ranges=FLAT_RANGES, selector_params=FLAT_SELECTOR, always_keep=["hour_sin"]
    )
    table = cut_lineage(model_input(spark, folder))
    return table, boosting.train_horizons(table, MODEL_FEATURES, ["hour_sin", "hour_cos"], "y", config)


@query("training_errors", f"""
WITH {v.PROD}, num AS (SELECT *, row_number() OVER w - 1 AS i FROM prod {W}), hs AS (SELECT unnest([1, 24]) AS h),
lab AS (SELECT a.series_id, h, a.ts, a.y, b.y AS actual FROM num a JOIN hs ON true JOIN num b ON b.series_id = a.series_id AND b.i = a.i + h WHERE b.y IS NOT NULL),
rolled AS (SELECT *, row_number() OVER (PARTITION BY series_id, h ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series_id, h) AS n,
  CASE WHEN count(y) OVER f >= 24 THEN quantile_cont(y, 0.99) OVER f END AS q FROM lab
  WINDOW f AS (PARTITION BY series_id, h ORDER BY ts ROWS BETWEEN 2159 PRECEDING AND CURRENT ROW)),
used AS (SELECT *, pos < n - (6 - fold) * (n // 6) AS train FROM (SELECT *, unnest(range(1, 6)) AS fold FROM rolled) WHERE pos < n - (5 - fold) * (n // 6)),
filled AS (SELECT *, CASE WHEN train THEN first_value(q IGNORE NULLS) OVER (PARTITION BY series_id, h, fold, train ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS d FROM used),
den AS (SELECT *, CAST(CAST(CASE WHEN train THEN d ELSE max_by(d, pos) FILTER (WHERE train) OVER (PARTITION BY series_id, h, fold) END AS FLOAT) AS DOUBLE) AS den FROM filled),
lbl AS (SELECT *, actual / nullif(den, 0) AS label FROM den WHERE den <> 0),
means AS (SELECT h, fold, avg(label) AS m FROM lbl WHERE train GROUP BY 1, 2),
errors AS (SELECT h, fold, sqrt(avg((actual - m * den) ** 2)) AS e FROM lbl JOIN means USING (h, fold) WHERE NOT train GROUP BY 1, 2)
SELECT CAST(h AS INTEGER) AS horizon, CASE WHEN h <= 3 THEN 'short' WHEN h <= 12 THEN 'mid' ELSE 'long' END AS feature_set,
  CAST(1 AS INTEGER) AS n_features, {r('avg(e)', 'rmse', 3)} FROM errors GROUP BY 1, 2""")
def _(spark, folder):
    from heliotide.learning import registry

    path = shared_dir(spark)
    registry.log_run(spark, flat_training(spark, folder, 5)[1], path)
    records = registry.read_runs(spark, path).select("horizon", "feature_set", F.col("n_features").cast("int").alias("n_features"), "rmse")
    return rounded(records, "rmse", places=3)


@query("trained_walk_forward", f"""
WITH {v.PROD}, num AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM prod {W}), hs AS (SELECT unnest([1, 24]) AS h),
rolled AS (SELECT *, CASE WHEN count(y) OVER f >= 24 THEN quantile_cont(y, 0.99) OVER f END AS q FROM num WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 2159 PRECEDING AND CURRENT ROW)),
den AS (SELECT series_id, ts, i, n, y, CAST(CAST(first_value(q IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS FLOAT) AS DOUBLE) AS d FROM rolled),
means AS (SELECT h, avg(b.y / a.d) AS m FROM den a JOIN hs ON true JOIN den b ON b.series_id = a.series_id AND b.i = a.i + h WHERE a.d <> 0 GROUP BY 1),
walk AS (SELECT t.series_id, o.ts AS origin_ts, o.d, CAST(t.i - o.i AS INTEGER) AS horizon, t.y AS actual, p.y AS baseline
  FROM den o JOIN den t ON t.series_id = o.series_id AND t.i BETWEEN o.i + 1 AND o.i + 24 LEFT JOIN den p ON p.series_id = t.series_id AND p.i = t.i - 24
  WHERE o.i + 1 >= 48 AND o.i + 1 < o.n - 24),
made AS (SELECT walk.*, CASE WHEN m IS NOT NULL THEN greatest(m, 0) * d END AS prediction FROM walk LEFT JOIN means ON h = horizon)
SELECT series_id, horizon, count(actual - prediction) AS n, count(*) FILTER (WHERE actual IS NOT NULL AND prediction IS NULL) AS n_missing,
  {r('sqrt(avg((actual - prediction) ** 2))', 'rmse', 3)}, {r('avg(abs(actual - prediction))', 'mae', 3)},
  {r('1 - sqrt(avg((actual - prediction) ** 2)) / nullif(sqrt(avg((actual - baseline) ** 2)), 0)', 'skill', 5)}
FROM made GROUP BY series_id, horizon""")
def _(spark, folder):
    from heliotide.plans.jobs import walk_forward_of

    table, model = flat_training(spark, folder, 2)
    made = cut_lineage(walk_forward_of(model, table, "y"))
    found = evaluate.skill_table(made).where("horizon IS NOT NULL").join(evaluate.prediction_coverage(made).drop("n_actual"), [SERIES, "horizon"])
    columns = found.select(SERIES, F.col("horizon").cast("int").alias("horizon"), "n", "n_missing", "rmse", "mae", "skill")
    return rounded(rounded(columns, "rmse", "mae", places=3), "skill", places=5)


_SIDES = "SELECT event_type AS series_id, value AS x, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'r' ELSE 'c' END AS side FROM events"


@query("drift_index", f"""
WITH s AS ({_SIDES}), e AS (SELECT series_id, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM s WHERE side = 'r' GROUP BY 1),
b AS (SELECT s.series_id, side, len(list_filter(edges, lambda q: q < x)) AS bin FROM s JOIN e USING (series_id) WHERE x IS NOT NULL),
n AS (SELECT series_id, count(*) FILTER (WHERE side = 'r') AS nr, count(*) FILTER (WHERE side = 'c') AS nc FROM b GROUP BY 1),
g AS (SELECT n.*, i, (SELECT count(*) FROM b WHERE b.series_id = n.series_id AND bin = i AND side = 'r') AS r, (SELECT count(*) FROM b WHERE b.series_id = n.series_id AND bin = i AND side = 'c') AS c
  FROM n, (SELECT unnest(range(0, 10)) AS i)),
p AS (SELECT series_id, nr, nc, (r + 0.5) / (nr + 5.0) AS q, (c + 0.5) / (nc + 5.0) AS p FROM g),
d AS (SELECT series_id, nr AS n_reference, nc AS n_current, sum((p - q) * ln(p / q)) AS drift FROM p GROUP BY ALL)
SELECT series_id, n_reference, n_current, {r('drift', 'drift')}, drift >= 0.25 AS drifted FROM d""")
def _(spark, folder):
    events = v.records(spark, folder)
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    early, late = events.where(F.col(TS) < middle), events.where(F.col(TS) >= middle)
    return rounded(evaluate.drift_index(early, late, evaluate.drift_edges(early, "y"), "y"), "drift")


@query("symmetric_error", f"""
SELECT event_type AS series_id, count(value) AS n, {r('avg(CASE WHEN abs(value) + abs(user_id) = 0 THEN 0 ELSE 2 * abs(value - user_id) / (abs(value) + abs(user_id)) END) * 100', 'smape')}
FROM events GROUP BY 1""")
def _(spark, folder):
    events = v.table(spark, folder, "events").select(F.col("event_type").alias(SERIES), F.col("value").alias("actual"), F.col("user_id").alias("prediction"))
    return rounded(evaluate.symmetric_error(events, by=[SERIES]), "smape")
