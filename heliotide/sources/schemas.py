"""Schemas of the landing files and of the tables the jobs keep, as DDL."""

PRODUCTION = "code_insee_region string, date string, heure string, date_heure string, solaire double"
PRODUCTION_PAYLOAD = (
    "results array<struct<code_insee_region: string, date: string, heure: string, "
    "date_heure: string, solaire: double>>"
)
WEATHER_RESPONSE = (
    "series_id string, point_id int, start timestamp, end timestamp, step_s int, vars map<string, array<float>>"
)
COORDINATES = "id int, geometry string"
CAPACITY_REGISTRY = "codeRegion int, dateMiseEnService string, filiere string, puisMaxInstallee double"
QUANTILES = "series_id string, p99_value double, computed_at timestamp"
PREDICTIONS = (
    "series_id string, predicted_at timestamp, forecast_horizon timestamp, predicted_value double"
)
FEATURE_SETS = "horizon_set string, feature string"
RUNS = (
    "run_id string, logged_at timestamp, horizon int, feature_set string, horizon_tag string, "
    "n_features int, rmse double, params map<string, string>, tags map<string, string>"
)
