import json
import math
from datetime import datetime

import pytest
from conftest import ordered

from heliotide.sources import readers, schemas, tables

RECORD = {"code_insee_region": "76", "date": "2024-01-01", "heure": "00:00", "date_heure": "2024-01-01T00:00:00+01:00", "solaire": 5.0}


def test_payload_json_and_parquet(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "p1.json").write_text(json.dumps({"results": [RECORD, {**RECORD, "solaire": None}]}, indent=1))
    assert readers.read_production(spark, str(folder)).count() == 2
    spark.createDataFrame([tuple(RECORD.values())], schemas.PRODUCTION).coalesce(1).write.parquet(str(tmp_path / "pq"))
    part = next((tmp_path / "pq").glob("*.parquet"))
    (folder / "p2.parquet").write_bytes(part.read_bytes())
    both = readers.read_production(spark, str(folder), ["solaire"])
    assert both.columns == ["solaire"] and both.count() == 3
    row = readers.hourly_input(readers.read_production(spark, str(folder), kind="auto")).first()
    assert row.ts == datetime(2023, 12, 31, 23, 0)


def test_pages_skip_bad_files_and_allow_none(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [RECORD]}))
    (tmp_path / "b.json").write_text("<html>busy</html>")
    (tmp_path / "c.json").write_text(json.dumps({"results": [RECORD, RECORD]}))
    assert readers.read_production_pages(spark, str(tmp_path)).count() == 3
    none = readers.read_production_pages(spark, str(tmp_path / "absent"))
    assert none.count() == 0 and "date_heure" in none.columns


def test_files_with_one_many_and_broken_pages(spark, tmp_path):
    page = lambda n: {"results": [RECORD] * n}
    (tmp_path / "one.json").write_text(json.dumps(page(2), indent=2))
    (tmp_path / "many.json").write_text("\n".join(json.dumps(page(n)) for n in (1, 3, 4)) + "\n\n")
    (tmp_path / "pretty.json").write_text("\n".join(json.dumps(page(n), indent=1) for n in (5, 6)))
    (tmp_path / "broken.json").write_text(json.dumps(page(1)) + "\n" + '{"results": [{"code"' + "\n")
    (tmp_path / "empty.json").write_text("")
    assert readers.read_production_pages(spark, str(tmp_path)).count() == 2 + 8 + 11 + 1
    assert readers.read_production(spark, str(tmp_path), kind="json").count() == 22
    report = readers.payload_report(readers.production_payloads(spark, str(tmp_path))).collect()
    got = {r["file"].rsplit("/", 1)[1]: (r["pages"], r["skipped_pages"], r["records"]) for r in report}
    assert got == {"one.json": (1, 0, 2), "many.json": (3, 0, 8), "pretty.json": (2, 0, 11), "broken.json": (2, 1, 1)}
    lines = readers.payload_report(readers.production_payloads(spark, str(tmp_path / "many.json"), "lines")).first()
    assert (lines["pages"], lines["records"]) == (3, 8)


def test_parquet_is_the_fallback_of_its_own_payload(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    spark.createDataFrame([tuple(RECORD.values())] * 3, schemas.PRODUCTION).coalesce(1).write.parquet(str(tmp_path / "pq"))
    part = next((tmp_path / "pq").glob("*.parquet")).read_bytes()
    for name, text in (("good", json.dumps({"results": [RECORD]})), ("bad", "<html>")):
        (folder / f"{name}.json").write_text(text)
        (folder / f"{name}.parquet").write_bytes(part)
    assert readers.read_production(spark, str(folder)).count() == 1 + 3


def test_unreadable_times_are_reported(spark):
    rows = [tuple(RECORD.values()), tuple({**RECORD, "date_heure": "soon"}.values()), tuple({**RECORD, "date_heure": None}.values())]
    df = spark.createDataFrame(rows, schemas.PRODUCTION)
    with pytest.raises(Exception, match="unreadable time"):
        readers.hourly_input(df).collect()
    assert readers.hourly_input(df, unreadable="skip").count() == 1
    assert readers.unreadable_times(df).first().asDict() == {"series_id": "76", "records": 3, "unreadable": 2}


def test_since_compares_instants(spark):
    rows = [tuple({**RECORD, "date_heure": t}.values()) for t in ("2024-01-01T00:30:00+01:00", "2024-01-01T01:00:00+02:00", "2024-01-01T00:00:00+00:00")]
    df = spark.createDataFrame(rows, schemas.PRODUCTION)
    got = readers.select_production(df, 76, "2024-01-01T00:30:00+01:00", ["date_heure"]).collect()
    assert [r.date_heure for r in got] == ["2024-01-01T00:30:00+01:00", "2024-01-01T00:00:00+00:00"]


def test_selection_is_pushed_down(spark, tmp_path):
    spark.createDataFrame([tuple(RECORD.values())], schemas.PRODUCTION).write.parquet(str(tmp_path / "p"))
    df = readers.select_production(spark.read.parquet(str(tmp_path / "p")), 76, "2023-12-31T23:00:00+00:00", ["solaire"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(code_insee_region,76)" in plan and "Or(IsNull(da" in plan.split("PushedFilters")[1]
    assert df.count() == 1


def test_weather_arrays(spark, tmp_path):
    lines = [
        {"series_id": "76", "point_id": 0, "start": "2024-01-01T00:00:00Z", "end": "2024-01-01T03:00:00Z", "step_s": 3600, "vars": {"t": [1.5, None, 3.5]}},
        {"series_id": "76", "point_id": 1, "start": "2024-01-01T00:00:00Z", "end": "2024-01-01T00:00:00Z", "step_s": 3600, "vars": {"t": []}},
    ]
    (tmp_path / "w.json").write_text("\n".join(map(json.dumps, lines)))
    got = ordered(readers.expand_weather(readers.read_weather(spark, str(tmp_path)), ["t", "other"]), "point_id", "ts")
    assert len(got) == 3 and got.t.tolist()[0] == 1.5 and math.isnan(got.t.tolist()[1])
    assert got.other.isna().all()


def test_coordinates(spark, tmp_path):
    df = spark.createDataFrame([(0, "POINT (1.44 43.6)"), (1, "POINT(-0.5 42)"), (2, "LINE (0 0)")], schemas.COORDINATES)
    got = ordered(readers.wkt_points(df), "id")
    assert got.lon.tolist()[:2] == [1.44, -0.5] and got.lat.tolist()[:2] == [43.6, 42.0] and math.isnan(got.lon[2])
    df.write.parquet(str(tmp_path / "l"))
    with pytest.raises(Exception, match="not a point"):
        readers.read_coordinates(spark, str(tmp_path / "l"))
    df.limit(0).write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError):
        readers.read_coordinates(spark, str(tmp_path / "c"))


def test_upserts_keep_the_newest(spark, tmp_path):
    path = str(tmp_path / "q")
    make = lambda *rows: spark.createDataFrame(list(rows), schemas.QUANTILES)
    at = lambda d, h=0: datetime(2024, 1, d, h)
    read = lambda: {r.series_id: r.p99_value for r in tables.read_quantiles(spark, path).collect()}
    assert read() == {}
    tables.upsert_quantiles(make(), path)
    assert read() == {}
    tables.upsert_quantiles(make(("a", 1.0, at(1)), ("b", 5.0, at(3))), path)
    tables.upsert_quantiles(make(("a", 2.0, at(2)), ("b", 6.0, at(2))), path)
    assert read() == {"a": 2.0, "b": 5.0}
    tables.upsert_quantiles(make(("a", 3.0, at(4))), path)
    tables.upsert_quantiles(make(("a", 4.0, at(4, 5)), ("b", 7.0, at(4, 1))), path)
    tables.upsert_quantiles(make(("a", 9.0, at(4, 2))), path)
    assert read() == {"a": 4.0, "b": 7.0}
    # one row per series and day
    assert tables.read_table(spark, path).count() == 6
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none"))


def test_an_upsert_touches_its_days_alone(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [(s, datetime(2024, 1, d), datetime(2024, 1, d, 1), float(d)) for s in "ab" for d in range(1, 11)]
    tables.upsert_predictions(spark.createDataFrame(rows, schemas.PREDICTIONS), path)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "p").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([("a", datetime(2024, 1, 4), datetime(2024, 1, 4, 1), 40.0), ("c", datetime(2024, 1, 20), datetime(2024, 1, 20, 1), 1.0)], schemas.PREDICTIONS)
    content = tables.upserted(new, path, tables.PREDICTION_KEYS, "predicted_at", "predicted_at")
    assert sorted((r["series_id"], r["predicted_value"]) for r in content.collect()) == [("a", 40.0), ("b", 4.0), ("c", 1.0)]
    plan = content._jdf.queryExecution().executedPlan().toString()
    assert "upsert_day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    tables.upsert_predictions(new, path)
    after = files()
    gone = before.keys() - after.keys()
    assert len({f.split("upsert_day=")[1][:10] for f in gone}) == 1 and all(after[k] == before[k] for k in before.keys() - gone)
    got = {(r.series_id, r.predicted_at.day): r.predicted_value for r in tables.read_predictions(spark, path).collect()}
    assert len(got) == 21 and got["a", 4] == 40.0 and got["b", 4] == 4.0 and got["c", 20] == 1.0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_days_do_not_depend_on_the_session(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        path = str(tmp_path / "q")
        rows = spark.sql("SELECT 'a' AS series_id, 1.0D AS p99_value, timestamp_seconds(1704067200 + 3600 * h) AS computed_at FROM VALUES (0), (23), (24) AS t(h)")
        tables.upsert_quantiles(rows, path)
        assert sorted(f.name for f in (tmp_path / "q").iterdir() if f.is_dir()) == ["upsert_day=2024-01-01", "upsert_day=2024-01-02"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_table_is_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    for value in ("a", "b"):
        tables.write_table(spark.createDataFrame([(value, 1)], "s string, k int"), path, ["k"])
    assert [r.s for r in tables.read_table(spark, path).collect()] == ["b"]


def test_later_delivery_wins_a_tie(spark, tmp_path):
    path, t = str(tmp_path / "p"), datetime(2024, 1, 1)
    for value in (1.0, 2.0):
        tables.upsert_predictions(spark.createDataFrame([("a", t, t, value)], schemas.PREDICTIONS), path)
    assert [r.predicted_value for r in tables.read_predictions(spark, path).collect()] == [2.0]


def test_latest_quantile_must_be_finite(spark):
    rows = [("a", 1.0, datetime(2024, 1, 1)), ("a", float("nan"), datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, schemas.QUANTILES)
    assert tables.latest_quantile(df.where("p99_value = 1")).first().p99_value == 1.0
    with pytest.raises(Exception, match="finite"):
        tables.latest_quantile(df).collect()
    more = df.union(spark.createDataFrame([("b", 7.0, datetime(2024, 1, 1))], schemas.QUANTILES))
    assert {r.series_id: r.p99_value for r in tables.latest_quantile(more, not_finite="last").collect()} == {"a": 1.0, "b": 7.0}
    assert [r.series_id for r in tables.stale_quantiles(more).collect()] == ["a"]


def test_csv_training_table_and_feature_sets(spark, tmp_path):
    rows = [("a", datetime(2024, 7, 1, 10, 0, 0, 123), 1.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, v double")
    tables.write_csv(df.select("ts", "series_id", "v"), str(tmp_path / "c"), ";")
    back = readers.read_csv(spark, str(tmp_path / "c"), "date timestamp, series_id string, v double")
    assert back.columns[0] == "ts" and back.first().ts == rows[0][1]
    tables.write_table(df, str(tmp_path / "t"))
    local = tables.load_training_table(spark, str(tmp_path / "t")).first().ts_local
    assert local == datetime(2024, 7, 1, 12, 0, 0, 123)
    sets = {"short": ["a", "b"], "long": ["c"]}
    tables.write_feature_sets(spark, sets, str(tmp_path / "f"))
    assert tables.read_feature_sets(spark, str(tmp_path / "f")) == sets
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "nothing"))
