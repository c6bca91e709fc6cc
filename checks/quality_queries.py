"""Data quality, spatial reduction, capacity, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registered import query, r, rounded, rs
from heliotide import SERIES, TS
from heliotide.operators import capacity, quality, spatial, stats

W = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"
CONTRACT = [
    quality.Range("l_quantity", 5, 45), quality.Range("l_discount", 0, 0.08, True),
    quality.Range("l_returnflag", 0, 1), quality.Range("l_weight", 0, 1),
]
KEYS = ["l_orderkey", "l_linenumber"]


def contract_input(spark, folder):
    return v.table(spark, folder, "lineitem").select(*KEYS, "l_quantity", "l_discount", "l_returnflag", "l_tax")


@query("contract_report", """
SELECT 'l_quantity' AS "column", 'type' AS rule, CAST(0 AS BIGINT) AS n_bad
UNION ALL SELECT 'l_quantity', 'not_null', count(*) FILTER (WHERE l_quantity IS NULL) FROM lineitem
UNION ALL SELECT 'l_quantity', 'min', count(*) FILTER (WHERE l_quantity < 5) FROM lineitem
UNION ALL SELECT 'l_quantity', 'max', count(*) FILTER (WHERE l_quantity > 45) FROM lineitem
UNION ALL SELECT 'l_discount', 'type', 0
UNION ALL SELECT 'l_discount', 'min', count(*) FILTER (WHERE l_discount < 0) FROM lineitem
UNION ALL SELECT 'l_discount', 'max', count(*) FILTER (WHERE l_discount > CAST(0.08 AS DOUBLE)) FROM lineitem
UNION ALL SELECT 'l_returnflag', 'type', count(*) FILTER (WHERE TRY_CAST(l_returnflag AS DOUBLE) IS NULL) FROM lineitem
UNION ALL SELECT 'l_returnflag', 'not_null', count(*) FILTER (WHERE l_returnflag IS NULL) FROM lineitem
UNION ALL SELECT 'l_returnflag', 'min', count(*) FILTER (WHERE TRY_CAST(l_returnflag AS DOUBLE) < 0) FROM lineitem
UNION ALL SELECT 'l_returnflag', 'max', count(*) FILTER (WHERE TRY_CAST(l_returnflag AS DOUBLE) > 1) FROM lineitem
UNION ALL SELECT 'l_weight', 'missing', 1
UNION ALL SELECT 'l_tax', 'unexpected', 1
UNION ALL SELECT 'l_orderkey,l_linenumber', 'unique', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
  FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def _(spark, folder):
    return quality.contract_report(contract_input(spark, folder), CONTRACT, KEYS)


@query("contract_violations", """
SELECT * FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
  concat_ws(',', CASE WHEN l_quantity < 5 THEN 'l_quantity:min' END, CASE WHEN l_quantity > 45 THEN 'l_quantity:max' END,
    CASE WHEN l_discount > CAST(0.08 AS DOUBLE) THEN 'l_discount:max' END) AS broken FROM lineitem) WHERE broken <> ''""")
def _(spark, folder):
    rows = contract_input(spark, folder).drop("l_returnflag", "l_tax")
    bad = quality.contract_violations(rows, CONTRACT[:2])
    return bad.withColumn("broken", F.array_join("broken", ","))


@query("coerced_columns", """
SELECT o_orderkey, TRY_CAST(left(o_orderpriority, 1) AS DOUBLE) AS grade, TRY_CAST(o_orderstatus AS DOUBLE) AS status FROM orders""")
def _(spark, folder):
    orders = v.table(spark, folder, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("grade"), F.col("o_orderstatus").alias("status")
    )
    return quality.coerce(orders, [quality.Range("grade", 0, 9), quality.Range("status", 0, 9)])


@query("target_value_counts", """
SELECT count(*) AS n_rows, count(value) AS n_values, count(value) > 0 AS usable FROM events""")
def _(spark, folder):
    events = quality.require_columns(v.table(spark, folder, "events"), ["ts", "value"])
    return quality.value_counts(events, "value")


@query("outlier_flags", """
WITH s AS (SELECT event_type AS series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
  avg(value) AS m, stddev_samp(value) AS d FROM events GROUP BY 1),
f AS (SELECT s.series_id, ts, value AS y, value <= q1 - 1.5 * (q3 - q1) OR value >= q3 + 1.5 * (q3 - q1) AS iqr_outlier,
  abs((value - m) / d) > 3 AS z_outlier FROM events JOIN s ON s.series_id = event_type)
SELECT *, iqr_outlier AND z_outlier AS outlier FROM f""")
def _(spark, folder):
    return quality.flag_outliers(v.records(spark, folder), "y")


@query("missing_runs", f"""
WITH {v.GRID}, m AS (SELECT series_id, ts, y IS NULL AS missing FROM grid),
s AS (SELECT *, CASE WHEN missing AND NOT coalesce(lag(missing) OVER w, false) THEN 1 ELSE 0 END AS starts,
  lead(ts) OVER w IS NULL AS final FROM m {W}),
n AS (SELECT *, sum(starts) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run_no FROM s)
SELECT series_id, CAST(run_no AS BIGINT) AS run_no, min(ts) AS start, max(ts) AS "end", count(*) AS n_missing, bool_or(final) AS open
FROM n WHERE missing GROUP BY series_id, run_no HAVING count(*) > 1""")
def _(spark, folder):
    return quality.missing_runs(v.gridded(spark, folder), "y", max_gap=1)


@query("dataset_summary", """
SELECT count(*) AS n_rows, CAST(6 AS INTEGER) AS n_columns, min(ts) AS start, max(ts) AS "end",
  CAST(sum((event_id IS NULL)::INT + (ts IS NULL)::INT + (user_id IS NULL)::INT + (event_type IS NULL)::INT + (value IS NULL)::INT + (props IS NULL)::INT) AS BIGINT) AS n_nulls
FROM events""")
def _(spark, folder):
    return quality.summary(v.table(spark, folder, "events"))


PROFILE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


def _profile_line(c):
    if c == "l_returnflag":
        return f"SELECT '{c}' AS \"column\", 'string' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS n_null, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS p25, NULL::DOUBLE AS p50, NULL::DOUBLE AS p75 FROM lineitem"
    return (
        f"SELECT '{c}' AS \"column\", 'double' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS n_null, round(avg({c}), 3) AS mean, "
        f"round(stddev_samp({c}), 3) AS std, min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 3) AS p25, "
        f"round(quantile_cont({c}, 0.5), 3) AS p50, round(quantile_cont({c}, 0.75), 3) AS p75 FROM lineitem"
    )


@query("column_profile", " UNION ALL ".join(_profile_line(c) for c in PROFILE_COLUMNS))
def _(spark, folder):
    df = v.table(spark, folder, "lineitem").select(*PROFILE_COLUMNS)
    return rounded(quality.column_profile(df, percentiles=True), "mean", "std", "p25", "p50", "p75", places=3)


_TYPES = {"bigint": ["l_orderkey", "l_partkey", "l_suppkey"], "int": ["l_linenumber"], "double": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]}


@query("typed_profile", " UNION ALL ".join(
    f"SELECT '{dtype}' AS dtype, CAST({len(names)} AS BIGINT) AS n_columns, "
    f"CAST({' + '.join(f'count({c})' for c in names)} AS BIGINT) AS n_values FROM lineitem" for dtype, names in _TYPES.items()))
def _(spark, folder):
    """Columns per type, and the values they hold."""
    lines = v.table(spark, folder, "lineitem").select(*[c for names in _TYPES.values() for c in names])
    held = [
        lines.agg(sum(F.count(c) for c in names).alias("n_values")).select(F.lit(dtype).alias("dtype"), "n_values")
        for dtype, names in _TYPES.items()
    ]
    values = held[0].unionByName(held[1]).unionByName(held[2])
    return quality.type_counts(lines).join(values, "dtype").select("dtype", "n_columns", "n_values")


@query("duplicate_share", """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates, round(sum(n - 1) * 100.0 / sum(n), 6) AS duplicate_pct
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag)""")
def _(spark, folder):
    df = v.table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag")
    return rounded(quality.duplicate_share(df), "duplicate_pct")


# --- space ----------------------------------------------------------------

@query("central_and_dispersion", f"""
WITH {v.WEATHER} SELECT ts, {r('max(v) FILTER (WHERE point_id = 13)', 'v')},
  round_even(max(v) FILTER (WHERE point_id <> 13) - min(v) FILTER (WHERE point_id <> 13), 4) AS v_delta_minmax,
  round_even(stddev_samp(v) FILTER (WHERE point_id <> 13), 4) AS v_std FROM weather GROUP BY 1""")
def _(spark, folder):
    return rounded(spatial.central_and_dispersion(v.weather(spark, folder), ["v"], 13), "v")


@query("central_point_rows", f"""
WITH {v.WEATHER} SELECT point_id = 13 AS central, count(*) AS n, {r('sum(v)', 'total', 3)} FROM weather GROUP BY 1""")
def _(spark, folder):
    central, others = spatial.split_central(v.weather(spark, folder), 13)
    both = central.withColumn("central", F.lit(True)).unionByName(others.withColumn("central", F.lit(False)))
    return rounded(both.groupBy("central").agg(F.count("*").alias("n"), F.sum("v").alias("total")), "total", places=3)


@query("weighted_centres", f"""
WITH s AS (SELECT c_nationkey AS dept, CAST(c_custkey % 90 AS DOUBLE) AS lat, CAST(c_custkey % 180 AS DOUBLE) AS lon, abs(c_acctbal) AS weight FROM customer)
SELECT dept, {r('sum(lat * weight) / sum(weight)', 'lat')}, {r('sum(lon * weight) / sum(weight)', 'lon')}, {r('sum(weight)', 'weight', 2)},
  grouping(dept) = 1 AS overall FROM s GROUP BY GROUPING SETS ((dept), ())""")
def _(spark, folder):
    centres = spatial.weighted_centres(v.sites(spark, folder), "dept", "weight")
    return rounded(rounded(centres, "lat", "lon"), "weight", places=2)


# --- capacity -------------------------------------------------------------

def daily_power(spark, folder):
    return capacity.daily_power(v.registry(spark, folder), "5-LOW")


@query("daily_power", f"WITH {v.DAILY_POWER} SELECT series_id, day, {r('power', 'power', 2)} FROM daily")
def _(spark, folder):
    return rounded(daily_power(spark, folder), "power", places=2)


@query("daily_power_of_region", f"WITH {v.DAILY_POWER} SELECT series_id, day, {r('power', 'power', 2)} FROM daily WHERE series_id = '2'")
def _(spark, folder):
    return rounded(capacity.daily_power(v.registry(spark, folder), "5-LOW", 2), "power", places=2)


def _repaired(pct):
    return f"""
WITH {v.DAILY_POWER}, s AS (SELECT series_id, coalesce(sum(power) FILTER (WHERE day < DATE '1995-02-01'), 0) * 100
  / sum(power) FILTER (WHERE day >= DATE '1995-02-01') AS pct, min(day) FILTER (WHERE day >= DATE '1995-02-01') AS first FROM daily GROUP BY 1)
SELECT d.series_id, CASE WHEN day < DATE '1995-02-01' THEN first ELSE day END AS day, {r('power', 'power', 2)}
FROM daily d JOIN s ON s.series_id = d.series_id WHERE day >= DATE '1995-02-01' OR pct >= {pct}"""


@query("old_dates_moved", _repaired(0.01))
def _(spark, folder):
    return rounded(capacity.repair_old_dates(daily_power(spark, folder), "1995-02-01"), "power", places=2)


@query("old_dates_dropped", _repaired(50))
def _(spark, folder):
    return rounded(capacity.repair_old_dates(daily_power(spark, folder), "1995-02-01", 50), "power", places=2)


CAPACITY = v.DAILY_POWER + """,
level AS (SELECT series_id, day, sum(power) OVER (PARTITION BY series_id ORDER BY day ROWS UNBOUNDED PRECEDING) / 1000 AS capacity FROM daily),
weekly AS (SELECT series_id, day, avg(capacity) OVER (PARTITION BY series_id, date_trunc('week', day)) AS capacity FROM level WHERE day >= DATE '1996-01-01'),
cut AS (SELECT * FROM weekly WHERE day < DATE '1998-06-01')"""


@query("cumulative_capacity", f"""
WITH {CAPACITY} SELECT series_id, day, {r('capacity', 'capacity', 7)} FROM level WHERE day >= DATE '1996-01-01' AND day < DATE '1998-06-01'""")
def _(spark, folder):
    level = capacity.cumulative_capacity(daily_power(spark, folder), "1996-01-01", "1998-06-01")
    return rounded(level, "capacity", places=7)


@query("weekly_capacity", f"WITH {CAPACITY} SELECT series_id, day, {r('capacity', 'capacity', 7)} FROM cut")
def _(spark, folder):
    return rounded(capacity.weekly_capacity(daily_power(spark, folder), "1996-01-01", "1998-06-01"), "capacity", places=7)


@query("hourly_capacity", f"""
WITH {CAPACITY}, nxt AS (SELECT series_id, day, capacity, coalesce(lead(day) OVER (PARTITION BY series_id ORDER BY day), day + 1) AS until FROM cut)
SELECT series_id, unnest(generate_series(CAST(day AS TIMESTAMP), CAST(until AS TIMESTAMP) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts,
  {r('capacity', 'capacity', 7)} FROM nxt""")
def _(spark, folder):
    return rounded(capacity.hourly_capacity(daily_power(spark, folder), "1996-01-01", "1998-06-01"), "capacity", places=7)


# --- statistics -----------------------------------------------------------

@query("distribution_shape", f"""
WITH m AS (SELECT event_type AS series_id, count(value) AS n, skewness(value) AS skewness, kurtosis(value) AS kurtosis, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1),
z AS (SELECT event_type AS series_id, avg(((value - m) / s) ** 3) AS g1, avg(((value - m) / s) ** 4) - 3 AS g2 FROM events JOIN m ON m.series_id = event_type GROUP BY 1),
j AS (SELECT m.series_id, n, skewness, kurtosis, n / 6.0 * (g1 * g1 + g2 * g2 / 4) AS jb FROM m JOIN z ON z.series_id = m.series_id)
SELECT series_id, n, {r('skewness', 'skewness')}, {r('kurtosis', 'kurtosis')}, {r('jb', 'jarque_bera', 3)}, {r('exp(-jb / 2)', 'p_value')} FROM j""")
def _(spark, folder):
    shape = stats.distribution_shape(v.records(spark, folder), "y")
    return rounded(rounded(shape, "skewness", "kurtosis", "p_value"), "jarque_bera", places=3)


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs(table, columns, name, labels=None):
    lines = []
    for a, first in zip(columns, labels or columns):
        for b, second in zip(columns, labels or columns):
            value = "CAST(1.0 AS DOUBLE)" if a == b else f"(SELECT round(corr({a}, {b}), 6) FROM {table})"
            lines.append(f"SELECT '{first}' AS a, '{second}' AS b, {value} AS {name}")
    return " UNION ALL ".join(lines)


@query("pearson_matrix", _pairs("lineitem", CORR, "pearson"))
def _(spark, folder):
    return rounded(stats.pearson(v.table(spark, folder, "lineitem"), CORR), "pearson")


_RANKED = "ranked AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in CORR
) + " FROM lineitem)"


@query("spearman_matrix", f"WITH {_RANKED} " + _pairs("ranked", [f"r_{c}" for c in CORR], "spearman", CORR))
def _(spark, folder):
    return rounded(stats.spearman(v.table(spark, folder, "lineitem"), CORR), "spearman")


@query("correlation_difference", f"WITH {_RANKED}, p AS ({_pairs('lineitem', CORR, 'pearson')}), s AS ({_pairs('ranked', ['r_' + c for c in CORR], 'spearman', CORR)}) "
       "SELECT p.a, p.b, pearson, spearman, round(pearson - spearman, 5) AS difference FROM p JOIN s ON p.a = s.a AND p.b = s.b")
def _(spark, folder):
    both = stats.correlation_difference(v.table(spark, folder, "lineitem"), CORR)
    return rounded(rounded(both, "pearson", "spearman"), "difference", places=5)


@query("histogram", f"""
WITH b AS (SELECT event_type AS series_id, min(value) AS lo, max(value) AS hi, count(*) AS total FROM events GROUP BY 1),
x AS (SELECT b.*, (hi - lo) / 20 AS width, value FROM events JOIN b ON b.series_id = event_type)
SELECT series_id, CAST(least(floor((value - lo) / width), 19) AS BIGINT) AS bin, {r('any_value(lo + least(floor((value - lo) / width), 19) * width)', 'low')},
  {r('any_value(lo + (least(floor((value - lo) / width), 19) + 1) * width)', 'high')}, count(*) AS n, {r('count(*) / any_value(total * width)', 'density')}
FROM x GROUP BY 1, 2""")
def _(spark, folder):
    return rounded(stats.histogram(v.records(spark, folder), "y"), "low", "high", "density")


@query("box_by_month", f"""
WITH p AS (SELECT CAST(month(o_orderdate) AS INTEGER) AS month, o_totalprice AS x FROM orders WHERE o_totalprice > 0),
q AS (SELECT month, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM p GROUP BY 1),
f AS (SELECT p.month, x, q1, median, q3, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM p JOIN q ON p.month = q.month)
SELECT month, count(*) AS n, {r('any_value(q1)', 'q1', 3)}, {r('any_value(median)', 'median', 3)}, {r('any_value(q3)', 'q3', 3)},
  {r('min(x) FILTER (WHERE inside)', 'whisker_low', 3)}, {r('max(x) FILTER (WHERE inside)', 'whisker_high', 3)}, count(*) FILTER (WHERE NOT inside) AS n_outside
FROM f GROUP BY 1""")
def _(spark, folder):
    orders = v.table(spark, folder, "orders").where("o_totalprice > 0")
    monthly = orders.select(F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("x"))
    return rounded(stats.box_summary(monthly, "x", ["month"]), "q1", "median", "q3", "whisker_low", "whisker_high", places=3)


@query("line_fit", f"""
SELECT l_returnflag AS series_id, {r('regr_slope(l_extendedprice, l_quantity)', 'slope', 3)}, {r('regr_intercept(l_extendedprice, l_quantity)', 'intercept', 3)},
  {r('regr_r2(l_extendedprice, l_quantity)', 'r2', 5)} FROM lineitem GROUP BY 1""")
def _(spark, folder):
    lines = v.table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", SERIES)
    return rounded(rounded(stats.line_fit(lines, "l_extendedprice", "l_quantity"), "slope", "intercept", places=3), "r2", places=5)


_ACF = f"""{v.PROD}, c AS (SELECT series_id, ts, y - avg(y) OVER (PARTITION BY series_id) AS d, row_number() OVER w AS i FROM prod {W}),
k AS (SELECT unnest(range(0, 97)) AS lag),
acf AS (SELECT a.series_id, CAST(lag AS INTEGER) AS lag, sum(a.d * b.d) / any_value(t.s) AS acf
FROM k JOIN c a ON true JOIN c b ON a.series_id = b.series_id AND a.i = b.i + lag
JOIN (SELECT series_id, sum(d * d) AS s FROM c GROUP BY 1) t ON t.series_id = a.series_id GROUP BY 1, 2)"""


@query("autocorrelation", f"WITH {_ACF} SELECT series_id, lag, {r('acf', 'acf')} FROM acf")
def _(spark, folder):
    return rounded(stats.autocorrelation(v.prod(spark, folder), "y"), "acf")


@query("partial_autocorrelation", f"""
WITH RECURSIVE {_ACF}, rho AS (SELECT series_id, list(acf ORDER BY lag) AS rho FROM acf GROUP BY 1),
step AS (
  SELECT series_id, 0 AS lag, rho, CAST([] AS DOUBLE[]) AS phi, CAST(1 AS DOUBLE) AS error, CAST(1 AS DOUBLE) AS pacf FROM rho
  UNION ALL
  SELECT series_id, lag + 1, rho, list_append(list_transform(range(1, lag + 1), lambda j: phi[j] - r * phi[lag + 1 - j]), r), error * (1 - r * r), r
  FROM (SELECT *, (rho[lag + 2] - coalesce(list_sum(list_transform(range(1, lag + 1), lambda j: phi[j] * rho[lag + 2 - j])), 0)) / error AS r FROM step WHERE lag < len(rho) - 1)
)
SELECT series_id, CAST(lag AS INTEGER) AS lag, {r('pacf', 'pacf')} FROM step""")
def _(spark, folder):
    return rounded(stats.partial_autocorrelation(stats.autocorrelation(v.prod(spark, folder), "y")), "pacf")


@query("cross_correlation", f"""
WITH {v.BOTH}, c AS (SELECT series_id, ts, a - avg(a) OVER s AS a, b - avg(b) OVER s AS b, row_number() OVER w AS i FROM ab {W}, s AS (PARTITION BY series_id)),
t AS (SELECT series_id, count(*) * stddev_pop(a) * stddev_pop(b) AS d FROM c GROUP BY 1), k AS (SELECT unnest(range(0, 72)) AS lag)
SELECT x.series_id, 'a' AS covariate, CAST(lag AS INTEGER) AS lag, {r('sum(x.a * y.b) / any_value(d)', 'ccf')}
FROM k JOIN c y ON true JOIN c x ON x.series_id = y.series_id AND x.i = y.i + lag JOIN t ON t.series_id = x.series_id GROUP BY 1, 3""")
def _(spark, folder):
    return rounded(stats.cross_correlation(v.both_halves(spark, folder), ["a"], "b"), "ccf")


@query("additive_decomposition", f"""
WITH {v.PROD}, t AS (SELECT series_id, ts, y, CASE WHEN count(y) OVER f = 25 THEN (avg(y) OVER l + avg(y) OVER h) / 2 END AS trend FROM prod
  WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING),
  l AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING),
  h AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING)),
m AS (SELECT series_id, hour(ts) AS hr, avg(y - trend) AS raw FROM t GROUP BY 1, 2),
s AS (SELECT series_id, hr, raw - avg(raw) OVER (PARTITION BY series_id) AS seasonal FROM m)
SELECT t.series_id, t.ts, {r('y', 'y', 9)}, {r('trend', 'trend', 9)}, {r('seasonal', 'seasonal', 9)}, {r('y - trend - seasonal', 'remainder', 9)}
FROM t JOIN s ON s.series_id = t.series_id AND s.hr = hour(t.ts)""")
def _(spark, folder):
    return rounded(stats.decompose_additive(v.prod(spark, folder), "y"), "y", "trend", "seasonal", "remainder", places=9)
