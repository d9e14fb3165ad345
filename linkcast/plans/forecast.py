"""Forecasters on MLlib, their parameter search, scoring and importance."""

from __future__ import annotations

import logging
import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from math import prod

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from linkcast.functions.scalar import r_squared, rmse
from linkcast.plans import trees
from linkcast.plans.dataset import Dataset

log = logging.getLogger("linkcast")

# Search grids over the parameters that have an equivalent here.
GBT_GRID = {
    "learning_rate": [0.01, 0.05, 0.1, 0.3],
    "n_estimators": [100, 300, 500, 1000],
    "max_depth": [3, 5, 7, 10, None],
    "min_child_weight": [1, 5, 10, 20],
    "colsample_bytree": [0.8, 0.9, 1.0],
    "subsample": [0.8, 0.9, 1.0],
}
# Accepted parameter names and what they set on GBTRegressor.
GBT_PARAMS = {
    "learning_rate": "stepSize",
    "n_estimators": "maxIter",
    "max_depth": "maxDepth",
    "min_child_weight": "minInstancesPerNode",
    "min_data_in_leaf": "minInstancesPerNode",
    "subsample": "subsamplingRate",
    "bagging_fraction": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy",
    "feature_fraction": "featureSubsetStrategy",
}
FOREST_SETTINGS = {"numTrees", "maxDepth", "featureSubsetStrategy", "maxMemoryInMB"}  # others go to MLlib's own trees
UNLIMITED_DEPTH = 30  # the deepest tree that MLlib grows
TRAIN_ROWS = 50_000  # training rows that are worth a partition while trees grow
# Statistics of nodes that grow in one pass: few enough to stay near the processor's caches and
# to leave executors their memory. Nodes do not depend on it.
TREE_MEMORY_MB = 64


def gbt_settings(params: Mapping) -> dict:
    """Booster parameters as GBTRegressor arguments."""
    out = {}
    for name, value in params.items():
        if name not in GBT_PARAMS:
            raise ValueError(f"parameter {name} has no equivalent in gradient-boosted trees here")
        if name == "max_depth" and value in (None, -1):
            log.warning("unlimited depth is replaced by %d", UNLIMITED_DEPTH)
            value = UNLIMITED_DEPTH
        if GBT_PARAMS[name] == "featureSubsetStrategy":
            value = "all" if float(value) == 1.0 else str(float(value))
        out[GBT_PARAMS[name]] = value
    return out


@dataclass
class Fitted:
    """A trained forecaster; ``model`` is None for the naive one."""

    name: str
    model: PipelineModel | None
    features: list[str]
    complexity: int
    training_time: float
    last_value: str | None = None  # of a naive forecast of levels: the newest sample known
    grown: GBTRegressionModel | None = None  # all trees of a boosted model that was shortened
    stage_errors: tuple[float, ...] = ()  # validation error after each grown tree
    ensemble: trees.Ensemble | None = None  # the trees of ``model`` in arrays, for scoring
    all_trees: trees.Ensemble | None = None  # those of ``grown``

    def score(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            return df.withColumn("prediction", F.col(self.last_value) if self.last_value else F.lit(0.0))
        if self.ensemble is not None:
            return df.withColumn("prediction", trees.predictions(self.ensemble, self.features))
        return self.model.transform(df).drop("features")


def _assemble(features: Sequence[str]):
    return VectorAssembler(inputCols=list(features), outputCol="features")


def _naive(ds: Dataset, params, seed) -> Fitted:
    # No change: a difference of zero, or for level targets the last sample of the window.
    last = ds.features[-1] if ds.target_kind == "level" else None
    return Fitted("Naive", None, ds.features, 0, 0.0, last)


def _linear(ds: Dataset, params, seed) -> Fitted:
    settings = dict(solver="normal", regParam=0.0) | dict(params)
    est = LinearRegression(labelCol="y", **settings)
    model = Pipeline(stages=[_assemble(ds.features), est]).fit(ds.part("train"))
    return Fitted("Linear Regression", model, ds.features, len(ds.features) + 1, 0.0)


@contextmanager
def training_vectors(ds: Dataset, columns: Sequence[str] = ()) -> Iterator[tuple[VectorAssembler, DataFrame]]:
    """The assembler and the assembled training rows, kept in no more partitions than there are cores.

    Trees read them once per level; many small files would be a task each, every time. Every
    partition shuffles statistics of every node, whatever its rows: partitions by rows alone would
    let that grow with rows times nodes.
    """
    assemble = _assemble(ds.features)
    rows = ds.df if columns else ds.part("train")
    cores = ds.df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, -(-rows.count() // TRAIN_ROWS)))
    kept = assemble.transform(rows).select("features", "y", *columns).repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield assemble, kept
    finally:
        kept.unpersist()


def _forest(ds: Dataset, params, seed) -> Fitted:
    settings = dict(
        numTrees=100, maxDepth=10, featureSubsetStrategy="all", maxMemoryInMB=TREE_MEMORY_MB,
    ) | dict(params)
    est = RandomForestRegressor(labelCol="y", seed=seed, **settings)
    if settings["featureSubsetStrategy"] != "all" or not set(settings) <= FOREST_SETTINGS:
        with training_vectors(ds) as (assemble, rows):
            model = PipelineModel([assemble, est.fit(rows)])
        return Fitted("Random Forest", model, ds.features, model.stages[-1].totalNumNodes, 0.0)
    grown = trees.forest(ds.part("train"), ds.features, settings["numTrees"], settings["maxDepth"], seed)
    model = PipelineModel([_assemble(ds.features), trees.to_mllib(grown, est, ds.df.sparkSession)])
    return Fitted("Random Forest", model, ds.features, model.stages[-1].totalNumNodes, 0.0, ensemble=grown)


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the first ``n`` trees: what boosting had after so many steps."""
    spark = SparkSession.active()
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    kinds = jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(kinds.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    for i, tree in enumerate(model.trees[:n]):
        trees[i] = tree._java_obj
        weights[i] = float(model.treeWeights[i])
    out = GBTRegressionModel(kinds.GBTRegressionModel(f"{model.uid}_{n}", trees, weights, model.numFeatures))
    return out._set(featuresCol=model.getFeaturesCol(), predictionCol=model.getPredictionCol())


def _boosting(ds: Dataset, params, seed) -> Fitted:
    """Boosted trees with early stopping.

    ``early_stopping_rounds`` (default 50) grows all trees, reads the validation
    error after each in one pass and keeps as many of them as were best. With ``stop_growing``
    no tree is grown that this rule cannot keep. 0 leaves the growing and stopping to MLlib,
    which ends at the first tree that gains too little.
    """
    settings = dict(learning_rate=0.1, n_estimators=300, max_depth=5) | dict(params)
    patience = settings.pop("early_stopping_rounds", 50)
    stop_growing = settings.pop("stop_growing", False)
    est = GBTRegressor(labelCol="y", seed=seed, maxMemoryInMB=TREE_MEMORY_MB, **gbt_settings(settings))
    if not patience:
        est.setValidationIndicatorCol("is_val")
        with training_vectors(ds, ["split"]) as (assemble, rows):
            rows = rows.where(F.col("split") != "test").withColumn("is_val", F.col("split") == "val")
            model = PipelineModel([assemble, est.fit(rows)])
        return Fitted("Gradient Boosting", model, ds.features, model.stages[-1].totalNumNodes, 0.0)
    val = ds.part("val")

    def enough(found) -> bool:
        errors = trees.errors_by_tree(found, val, ds.features)
        return bool(errors) and best_tree_count(errors, patience) + patience <= len(errors)

    every = trees.boost(
        ds.part("train"), ds.features, est.getMaxIter(), est.getMaxDepth(), est.getStepSize(), seed,
        est.getMinInstancesPerNode(), est.getSubsamplingRate(), _feature_share(est), enough if stop_growing else None,
    )
    # Without validation rows there is nothing to read: all trees stay.
    errors = trees.errors_by_tree(every, val, ds.features)
    best = best_tree_count(errors, patience) if errors else len(every.trees)
    grown = trees.to_mllib(every, est, ds.df.sparkSession)
    kept = grown if best == grown.getNumTrees else first_trees(grown, best)
    return Fitted(
        "Gradient Boosting", PipelineModel([_assemble(ds.features), kept]), ds.features, kept.totalNumNodes, 0.0,
        grown=grown, stage_errors=tuple(errors), ensemble=every.first(best), all_trees=every,
    )


def _feature_share(est: GBTRegressor) -> float:
    share = est.getFeatureSubsetStrategy()
    return 1.0 if share == "all" else float(share)


FORECASTERS: dict[str, Callable] = {
    "naive": _naive,
    "linear": _linear,
    "random_forest": _forest,
    "gbt": _boosting,
}


def register_forecaster(name: str, fit: Callable) -> None:
    """``fit(dataset, params, seed)`` returns a ``Fitted``."""
    FORECASTERS[name] = fit


def fit(name: str, ds: Dataset, params: Mapping | None = None, seed: int = 42) -> Fitted:
    if name not in FORECASTERS:
        raise ValueError(f"unknown forecaster {name}; known: {sorted(FORECASTERS)}")
    start = time.perf_counter()
    out = FORECASTERS[name](ds, params or {}, seed)
    if out.model is not None:
        out.training_time = time.perf_counter() - start
    return out


def scored_levels(scored: DataFrame) -> DataFrame:
    """Add the predicted level and the residual left after pre-compensation."""
    level = F.col("prediction") + F.col("level_lag")
    return scored.withColumn("predicted_level", level).withColumn(
        "residual", F.col("level") - level
    )


def metrics(scored: DataFrame, by: Sequence[str], y: str = "y", pred: str = "prediction"):
    """Errors per group of ``by`` (usually keys, horizon, model, split)."""
    e = F.col(y) - F.col(pred)
    return scored.groupBy(*by).agg(
        rmse(e).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        r_squared(y, e).alias("r2"),
        F.var_pop(e).alias("residual_variance"),
        F.var_pop(pred).alias("pred_variance"),
        F.var_pop(y).alias("target_variance"),
        F.count("*").alias("n"),
    )


def results_row(fitted: Fitted, ds: Dataset) -> DataFrame:
    """One results row: errors per split, times, complexity and sizes."""
    spark = ds.df.sparkSession
    start = time.perf_counter()
    scored = fitted.score(ds.part("test")).select("split", "y", "prediction").persist(StorageLevel.MEMORY_AND_DISK)
    n_test = scored.count()
    seconds = time.perf_counter() - start
    others = fitted.score(ds.df.where(F.col("split") != "test")).select("split", "y", "prediction")
    per = {r.split: r for r in metrics(scored.unionByName(others), ["split"]).collect()}
    scored.unpersist()
    train, val, test = (per.get(s) for s in ("train", "val", "test"))
    get = lambda r, k: None if r is None else r[k]
    row = (
        fitted.name, ds.horizon, ds.target_kind,
        get(train, "rmse"), get(val, "rmse"), get(test, "rmse"), get(test, "mae"), get(test, "r2"),
        get(test, "residual_variance"), get(test, "pred_variance"), get(test, "target_variance"),
        get(train, "residual_variance"), fitted.training_time,
        seconds / n_test * 1000 if n_test else 0.0,
        fitted.complexity, get(train, "n") or 0, n_test, None,
    )
    return spark.createDataFrame([row], RESULT_SCHEMA)


def failed_row(name: str, ds: Dataset, reason: str) -> DataFrame:
    """A results row without numbers for a model that could not be fitted or judged."""
    empty = [None] * (len(RESULT_SCHEMA.split(",")) - 4)
    return ds.df.sparkSession.createDataFrame([(name, ds.horizon, ds.target_kind, *empty, reason)], RESULT_SCHEMA)


RESULT_SCHEMA = (
    "model_name string, horizon int, target_kind string, train_rmse double, val_rmse double, "
    "test_rmse double, test_mae double, test_r2 double, residual_variance double, "
    "pred_variance double, target_variance double, precomp_variance_train double, "
    "training_time double, inference_time_per_sample_ms double, model_complexity long, "
    "n_train_samples long, n_test_samples long, error string"
)


def importance(fitted: Fitted, horizon: int, spark: SparkSession) -> DataFrame:
    """(model, horizon, feature, importance, rank): tree importances or coefficients."""
    last = fitted.model.stages[-1]
    weights = getattr(last, "featureImportances", None)
    values = weights.toArray() if weights is not None else last.coefficients.toArray()
    order = sorted(range(len(values)), key=lambda i: (-abs(values[i]), i))
    rows = [
        (fitted.name, horizon, fitted.features[i], float(values[i]), r + 1)
        for r, i in enumerate(order)
    ]
    schema = "model string, horizon int, feature string, importance double, rank int"
    return spark.createDataFrame(rows, schema)


def sample_grid(grid: Mapping[str, Sequence], max_trials: int, seed: int = 42) -> list[dict]:
    """Distinct random points of a grid, without listing the grid."""
    size = prod(len(v) for v in grid.values())
    picks = range(size) if size <= max_trials else random.Random(seed).sample(range(size), max_trials)
    out = []
    for index in picks:
        point = {}
        for name in reversed(list(grid)):
            index, k = divmod(index, len(grid[name]))
            point[name] = grid[name][k]
        out.append({name: point[name] for name in grid})
    return out


def sample_draws(grid: Mapping[str, Sequence], trials: int, seed: int = 42) -> list[dict]:
    """Independent draws per parameter; points may repeat."""
    rng = random.Random(seed)
    return [{name: rng.choice(list(values)) for name, values in grid.items()} for _ in range(trials)]


def tune(
    name: str,
    ds: Dataset,
    grid: Mapping[str, Sequence] | None = None,
    max_trials: int = 50,
    seed: int = 42,
    parallel: int = 4,
) -> tuple[dict | None, DataFrame]:
    """Best parameters by validation error (first wins) and the table of trials.

    A trial that fails is a row without errors, with the reason.
    """
    spark = ds.df.sparkSession
    points = sample_grid(GBT_GRID if grid is None else grid, max_trials, seed)
    ds.df.persist(StorageLevel.MEMORY_AND_DISK)

    def trial(item):
        i, params = item
        try:
            # Trees that early stopping cannot keep are not grown.
            fitted = fit(name, ds, {"stop_growing": True} | params if name == "gbt" else params, seed)
            per = {r.split: r.rmse for r in metrics(fitted.score(ds.df), ["split"]).collect()}
            return i, params, per["val"], per["train"], fitted.training_time, None
        except Exception as exc:  # the search goes on
            log.warning("trial %d failed: %s", i, exc)
            return i, params, None, None, None, str(exc)[:300]

    try:
        with ThreadPoolExecutor(parallel) as pool:
            done = list(pool.map(trial, enumerate(points)))
    finally:
        ds.df.unpersist()
    rows = [(i, {k: str(v) for k, v in p.items()}, *rest) for i, p, *rest in done]
    table = spark.createDataFrame(
        rows,
        "trial int, params map<string,string>, val_rmse double, train_rmse double, training_time double, error string",
    )
    judged = [t for t in done if t[2] is not None]
    best = min(judged, key=lambda t: (t[2], t[0]), default=None)
    return (best[1] if best else None), table


def train_horizons(
    sets: Mapping[int, Dataset],
    name: str,
    horizons: Sequence[int],
    params: Mapping | None = None,
    grid: Mapping | None = None,
    max_trials: int = 0,
    seed: int = 42,
) -> dict[int, tuple[Fitted | None, DataFrame, DataFrame | None]]:
    """Per horizon: the model, its results row and its feature importance.

    A horizon without training rows has no model and a row that says so.
    """
    out = {}
    for h in horizons:
        if h not in sets:
            log.warning("horizon %d was not prepared; skipped", h)
            continue
        ds, chosen = sets[h], params
        if not ds.part("train").limit(1).count():
            out[h] = (None, failed_row(name, ds, "no rows to train on"), None)
            continue
        if max_trials:
            chosen, _ = tune(name, ds, grid, max_trials, seed)
        fitted = fit(name, ds, chosen, seed)
        weights = importance(fitted, h, ds.df.sparkSession) if fitted.model is not None else None
        out[h] = (fitted, results_row(fitted, ds), weights)
    return out


def error_by_trees(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Mean squared error after each grown tree of a boosted model, from one scoring pass."""
    found = fitted.all_trees or fitted.ensemble
    if found is not None:
        errors = trees.errors_by_tree(found, df, fitted.features)
    else:
        errors = fitted.model.stages[-1].evaluateEachIteration(fitted.model.stages[0].transform(df), "squared")
    rows = [(i + 1, float(e)) for i, e in enumerate(errors)]
    return df.sparkSession.createDataFrame(rows, "trees int, mse double")


class PatienceRule:
    """Stop after ``patience`` steps that gain no more than ``min_delta``."""

    def __init__(self, patience: int = 10, min_delta: float = 0.0, mode: str = "min"):
        if mode not in ("min", "max"):
            raise ValueError(f"unknown mode: {mode}")
        self.patience, self.min_delta = patience, min_delta
        self.sign = 1 if mode == "min" else -1
        self.best, self.best_step, self.misses = None, None, 0

    def stop_after(self, step: int, value: float) -> bool:
        gain = None if self.best is None else (self.best - value) * self.sign
        if gain is None or gain > self.min_delta:
            self.best, self.best_step, self.misses = value, step, 0
        else:
            self.misses += 1
        return self.misses >= self.patience


def best_tree_count(errors: Sequence[float], patience: int = 50, min_delta: float = 0.0) -> int:
    """Trees to keep when the per-tree errors are read with a patience rule."""
    rule = PatienceRule(patience, min_delta)
    for trees, error in enumerate(errors, 1):
        if rule.stop_after(trees, error):
            break
    return rule.best_step or 1


def sequence_dataset(windows: DataFrame, keys, lookback: int, horizon: int) -> Dataset:
    """Lookback windows (columns X, y, split) as a data set for any forecaster."""
    if windows.schema["y"].dataType.typeName() == "array":
        # A sequence target is judged by its last step.
        windows = windows.withColumn("y", F.element_at("y", -1))
    names = [f"x{i}" for i in range(lookback)]
    df = windows.select(*keys, "seq", "split", *[F.col("X")[i].alias(n) for i, n in enumerate(names)], "y")
    return Dataset(df, None, names, horizon, tuple(keys), "level")


def sequence_vectors(windows: DataFrame) -> DataFrame:
    """Lookback arrays as MLlib vectors."""
    return windows.withColumn("features", array_to_vector("X"))
