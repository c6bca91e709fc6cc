"""Gradient-boosted trees per forecast horizon, on Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotide import SERIES, TS
from heliotide.functions.scaling import non_negative
from heliotide.operators.features import add_targets, align_to_target, pareto_select
from heliotide.operators.normalize import SeriesNormaliser, SeriesNormaliserModel
from heliotide.operators.shape import feature_union
from heliotide.operators.split import expanding_folds
from heliotide.session import cut_lineage

# Missing inputs become one value far below every scaled one, so a tree can
# split them off; Spark ML trees take no missing values.
MISSING = -1.0e9

# Selector horizons used for each training set.
SELECTOR_HORIZONS = {"short": [1, 3], "mid": [3, 6, 12], "long": [12, 24]}

# Searched ranges (low, high, scale). maxBins has no published
# counterpart; it stands in for the number of leaves, which Spark's trees do not take.
SEARCH_RANGES = {
    "maxDepth": (1, 30, "int"),
    "stepSize": (0.005, 0.2, "log"),
    "maxIter": (100, 1000, "int"),
    "minInstancesPerNode": (10, 50, "int"),
    "maxBins": (32, 256, "int"),
}
# The same search at a size that fits a test run.
SMALL_RANGES = {
    "maxDepth": (2, 3, "int"),
    "stepSize": (0.05, 0.2, "log"),
    "maxIter": (2, 4, "int"),
    "minInstancesPerNode": (10, 50, "int"),
    "maxBins": (16, 32, "int"),
}
SELECTOR_PARAMS = {"maxDepth": 5, "stepSize": 0.01, "maxIter": 500, "minInstancesPerNode": 20}
SMALL_SELECTOR_PARAMS = {"maxDepth": 3, "stepSize": 0.1, "maxIter": 3, "minInstancesPerNode": 20}


def assemble(df: DataFrame, features: Sequence[str], output: str = "inputs") -> DataFrame:
    """Vector of ``features``, missing values replaced by ``MISSING``."""
    filled = {f"_f{i}": F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(MISSING)) for i, c in enumerate(features)}
    assembler = VectorAssembler(inputCols=list(filled), outputCol=output)
    return assembler.transform(df.withColumns(filled)).drop(*filled)


def regressor(params: Mapping[str, float], seed: int = 42, output: str = "prediction") -> GBTRegressor:
    return GBTRegressor(
        featuresCol="inputs", labelCol="label", predictionCol=output, seed=seed, cacheNodeIds=False, **params
    )


# --- feature selection ----------------------------------------------------


def fit_gains(
    df: DataFrame, features: Sequence[str], target: str, horizons: Sequence[int], params: Mapping[str, float]
) -> DataFrame:
    """``(horizon, feature, gain)`` of one boosted-tree model per horizon (M5).

    Gains are those of the Spark trees. The targets of all horizons are built
    in one pass and written once for the fits to read.
    """
    wide = assemble(add_targets(df, target, horizons), features)
    table = cut_lineage(wide.select("inputs", *[f"{target}_h{h}" for h in horizons]))
    rows = []
    for h in horizons:
        train = table.select("inputs", F.col(f"{target}_h{h}").alias("label")).where("label is not null")
        gains = regressor(params).fit(train).featureImportances.toArray()
        rows += [(h, name, float(gain)) for name, gain in zip(features, gains)]
    return df.sparkSession.createDataFrame(rows, "horizon int, feature string, gain double")


def fit_selected_features(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    horizons: Sequence[int],
    params: Mapping[str, float],
    threshold: float = 0.95,
    always_keep: Sequence[str] = (),
) -> list[str]:
    """Union over horizons of the Pareto set, plus ``always_keep``.

    When the strongest feature alone reaches the threshold everywhere, it is
    kept.
    """
    gains = fit_gains(df, features, target, horizons, params)
    forced = [f for f in always_keep if f in df.columns]
    chosen = {r["feature"] for r in feature_union(pareto_select(gains, threshold), forced).collect()}
    if not chosen:
        chosen = {gains.orderBy(F.desc("gain"), "feature").first()["feature"]}
    return [f for f in dict.fromkeys([*features, *forced]) if f in chosen]


# --- parameter search -----------------------------------------------------


def sample_params(ranges: Mapping[str, tuple], trials: int, seed: int = 42) -> list[dict]:
    """Random points of the search space, the same for the same seed (M6)."""
    source = random.Random(seed)
    points = []
    for _ in range(trials):
        point = {}
        for name, (low, high, scale) in ranges.items():
            if scale == "int":
                point[name] = source.randint(low, high)
            else:
                point[name] = math.exp(source.uniform(math.log(low), math.log(high)))
        points.append(point)
    return points


def fold_rows(labelled: DataFrame, covariates: Sequence[str], target: str, folds: int) -> DataFrame:
    """Scaled rows of every fold with ``fold, role, label, actual, denominator`` (M3, M4).

    Each fold is normalised with what its own training rows know. Written once
    to the shared folder: selection and every trial read it, none recomputes it.
    """
    split = expanding_folds(labelled, folds)
    # each fold is a series of its own, so one normaliser pass serves all folds
    keyed = split.withColumn(SERIES, F.concat_ws("#", "fold", SERIES))
    model = SeriesNormaliser(covariates, target).fit(keyed.where("role = 'train'")).stored()
    return cut_lineage(_scale_rows(model, keyed), ("fold", "role"))


def fold_features(
    rows: DataFrame, features: Sequence[str], target: str, folds: int, horizons: Sequence[int], config: TrainingConfig
) -> dict[int, list[str]]:
    """Features of each fold, selected on its own training rows (M5).

    Targets of the selector are taken among those rows too, so no fold knows an
    hour that it is tested on.
    """
    def chosen(fold: int) -> list[str]:
        train = rows.where((F.col("fold") == fold) & (F.col("role") == "train"))
        return fit_selected_features(train, features, target, horizons, config.selector_params, config.threshold, config.always_keep)

    each = range(1, folds + 1)
    with ThreadPoolExecutor(config.parallel) as pool:
        return dict(zip(each, pool.map(chosen, each)))


def fold_table(rows: DataFrame, features: Mapping[int, Sequence[str]]) -> DataFrame:
    """``(fold, role, inputs, label, actual, denominator)`` with each fold's own features, written once."""
    parts = [
        assemble(rows.where(F.col("fold") == fold), chosen).select("fold", "role", "inputs", "label", "actual", "denominator")
        for fold, chosen in features.items()
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return cut_lineage(table, ("fold", "role"))


def _scale_rows(model: SeriesNormaliserModel, rows: DataFrame) -> DataFrame:
    """Scaled features, normalised ``label``, and ``actual``/``denominator`` to undo it."""
    scaled = model.scale(rows.withColumnRenamed("label", "actual"), as_is=["fold", "role", "actual"])
    return scaled.withColumn("label", F.try_divide("actual", "denominator"))


def search(
    table: DataFrame, folds: int, points: Sequence[Mapping[str, float]], parallel: int = 4
) -> tuple[float, dict]:
    """Best mean RMSE over folds, in the unit of the target, and its parameters.

    Every fold counts: one without a test row that has a value raises ValueError.
    """
    def error_of(task: tuple[int, int]) -> float:
        point, fold = task
        rows = table.where((F.col("fold") == fold) & F.col("label").isNotNull())
        model = regressor(points[point]).fit(rows.where("role = 'train'"))
        error = F.col("actual") - F.col("prediction") * F.col("denominator")
        found = model.transform(rows.where("role = 'test'")).agg(F.sqrt(F.avg(error * error))).first()[0]
        if found is None:
            raise ValueError(f"fold {fold} has no test row with a value")
        return found

    tasks = [(point, fold) for point in range(len(points)) for fold in range(1, folds + 1)]
    with ThreadPoolExecutor(parallel) as pool:
        errors = list(pool.map(error_of, tasks))
    scores = [sum(errors[i * folds : (i + 1) * folds]) / folds for i in range(len(points))]
    best = min(range(len(points)), key=lambda i: scores[i])
    return scores[best], dict(points[best])


# --- training -------------------------------------------------------------


@dataclass
class TrainingConfig:
    """Sizes of a training run; the defaults are the full settings."""

    horizons: Sequence[int] = tuple(range(1, 25))
    folds: int = 5
    trials: int = 25
    parallel: int = 4
    threshold: float = 0.95
    ranges: Mapping[str, tuple] = field(default_factory=lambda: dict(SEARCH_RANGES))
    selector_params: Mapping[str, float] = field(default_factory=lambda: dict(SELECTOR_PARAMS))
    always_keep: Sequence[str] = ()
    seed: int = 42

    @classmethod
    def small(cls, **changes) -> TrainingConfig:
        settings = {
            "horizons": (1, 12, 24), "folds": 2, "trials": 2,
            "ranges": dict(SMALL_RANGES), "selector_params": dict(SMALL_SELECTOR_PARAMS),
        }
        return cls(**{**settings, **changes})


@dataclass
class HorizonModel:
    """One trained horizon: normaliser is shared, features and trees are its own."""

    horizon: int
    feature_set: str
    features: list[str]
    trees: GBTRegressionModel
    rmse: float
    params: dict


@dataclass
class MultiHorizonModel:
    """All horizons with the normaliser fitted on the whole table."""

    normaliser: SeriesNormaliserModel
    horizons: dict[int, HorizonModel]

    def predict_wide(self, df: DataFrame, with_denominator: bool = False) -> DataFrame:
        """``(series_id, ts, +1h, ..)`` normalised, not below 0.

        The rows pass once through all models; horizons without a model are
        left out. ``with_denominator`` adds the row's ``denominator``.
        """
        rows, columns = self.normaliser.scale(df), []
        for h in sorted(self.horizons):
            part = self.horizons[h]
            trees = part.trees.copy().setFeaturesCol("inputs").setPredictionCol(f"+{h}h")
            rows = trees.transform(assemble(rows, part.features)).drop("inputs")
            columns.append(non_negative(F.col(f"`+{h}h`")).alias(f"+{h}h"))
        return rows.select(SERIES, TS, *columns, *(["denominator"] if with_denominator else []))


def set_name(horizon: int) -> str:
    return "short" if horizon <= 3 else "mid" if horizon <= 12 else "long"


def train_horizons(
    df: DataFrame,
    features: Sequence[str],
    covariates: Sequence[str],
    target: str,
    config: TrainingConfig | None = None,
) -> MultiHorizonModel:
    """Direct training: per horizon select, search and refit on all rows (M7).

    The denominator is fitted on the unshifted target and the target is
    shifted once. Features are selected once per training set: on all rows for
    the model, and on each fold's training rows for the errors of the search.
    """
    config = config or TrainingConfig()
    df = cut_lineage(df)
    normaliser = SeriesNormaliser(covariates, target).fit(df).stored()
    scaled = cut_lineage(normaliser.transform(df))
    points = sample_params(config.ranges, config.trials, config.seed)
    selected, by_fold, models = {}, {}, {}
    for h in config.horizons:
        name = set_name(h)
        labelled = align_to_target(df, target, h)
        rows = fold_rows(labelled, covariates, target, config.folds)
        if name not in selected:
            wanted = SELECTOR_HORIZONS[name]
            selected[name] = fit_selected_features(
                scaled, features, target, wanted, config.selector_params, config.threshold, config.always_keep
            )
            by_fold[name] = fold_features(rows, features, target, config.folds, wanted, config)
        chosen = selected[name]
        rmse, params = search(fold_table(rows, by_fold[name]), config.folds, points, config.parallel)
        final = assemble(_scale_rows(normaliser, labelled), chosen).where("label is not null")
        trees = regressor(params, config.seed).fit(cut_lineage(final.select("inputs", "label")))
        models[h] = HorizonModel(h, name, chosen, trees, rmse, params)
    return MultiHorizonModel(normaliser, models)
