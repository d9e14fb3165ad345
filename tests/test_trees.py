"""Trees from histograms: the same as MLlib's where few rows are grown, and as good on the executors."""

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from linkcast.catalog import QUERIES, models
from linkcast.plans import forecast as fc
from linkcast.plans import trees
from linkcast.plans.dataset import Dataset

NAMES = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def bent(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(3000, 6))
    X[:, 3] = X[:, 3].round()
    y = 3 * np.sin(X[:, 0]) + X[:, 1] * X[:, 2] + X[:, 3] + 0.5 * rng.normal(size=3000)
    pdf = pd.DataFrame(X, columns=NAMES).assign(y=y, split=["train"] * 2000 + ["val"] * 500 + ["test"] * 500)
    return Dataset(spark.createDataFrame(pdf).coalesce(1).cache(), None, NAMES, 5, ())


def numbers(df):
    return np.array([r[0] for r in df.select("prediction").collect()])


def test_forest_is_mllibs(bent):
    fitted = fc.fit("random_forest", bent, {"numTrees": 5})
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(bent.df)
    est = RandomForestRegressor(labelCol="y", seed=42, numTrees=5, maxDepth=10, featureSubsetStrategy="all")
    model = est.fit(vectors.where("split = 'train'").repartition(1))
    np.testing.assert_allclose(numbers(fitted.score(bent.df)), numbers(model.transform(vectors)), rtol=1e-12)
    np.testing.assert_allclose(numbers(fitted.model.transform(bent.df)), numbers(model.transform(vectors)), rtol=1e-12)
    np.testing.assert_allclose(fitted.model.stages[-1].featureImportances.toArray(), model.featureImportances.toArray(), rtol=1e-9)
    assert fitted.complexity == model.totalNumNodes


def test_boosting_is_mllibs(bent):
    fitted = fc.fit("gbt", bent, {"n_estimators": 6, "max_depth": 4, "min_child_weight": 5})
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(bent.df)
    est = GBTRegressor(labelCol="y", seed=42, maxIter=6, maxDepth=4, minInstancesPerNode=5)
    model = est.fit(vectors.where("split = 'train'").repartition(1))
    want = model.evaluateEachIteration(vectors.where("split = 'val'"), "squared")
    np.testing.assert_allclose(fitted.stage_errors, want, rtol=1e-9)
    assert fitted.grown.totalNumNodes == model.totalNumNodes


def test_executors_grow_the_same_boosted_trees(bent, monkeypatch):
    """Sums that meet from several partitions, and children by difference, give the trees of the driver."""
    train = bent.part("train")
    monkeypatch.setattr(trees, "CHECKPOINT", 2)
    near = trees.boost(train, NAMES, 5, 6, 0.3, 1, least=20)
    monkeypatch.setattr(trees, "CHUNK", 2)  # from the third level on the sums meet on the executors
    far = trees.boost(train.repartition(3), NAMES, 5, 6, 0.3, 1, least=20, local_rows=0)
    for a, b in zip(near.trees, far.trees):
        assert (a.feature, a.cut, a.kids) == (b.feature, b.cut, b.kids)
        np.testing.assert_allclose([x[:2] for x in a.sums], [x[:2] for x in b.sums], atol=1e-9)


def test_executors_grow_a_forest(bent, spark):
    y = np.array([r.y for r in bent.part("test").collect()])
    error = {}
    for rows in (None, 0):
        found = trees.forest(bent.part("train"), NAMES, 10, 8, 42, local_rows=rows)
        column = trees.predictions(found, NAMES).alias("prediction")
        error[rows] = np.sqrt(((numbers(bent.part("test").select(column)) - y) ** 2).mean())
    assert abs(error[0] / error[None] - 1) < 0.1 and error[0] < 0.75 * y.std()
    bags = np.array([trees._bags(42)(t, 7, 1000) for t in range(20)])
    assert abs(bags.mean() - 1) < 0.05 and abs(bags.var() - 1) < 0.1 and (bags[0] != bags[1]).any()


def test_stopping_keeps_the_best_trees(bent):
    params = {"n_estimators": 150, "max_depth": 3, "learning_rate": 0.5, "early_stopping_rounds": 5}
    whole, short = (fc.fit("gbt", bent, params | {"stop_growing": s}) for s in (False, True))
    assert len(short.stage_errors) < len(whole.stage_errors) == 150
    assert short.complexity == whole.complexity
    np.testing.assert_allclose(numbers(short.score(bent.df)), numbers(whole.score(bent.df)))


def test_search_runs_its_default_grid_and_trials(spark, monkeypatch):
    class Seen(Exception):
        pass

    def sample(grid, max_trials, seed):
        raise Seen(grid, max_trials)

    monkeypatch.setattr(models, "sets", lambda *_, **__: {5: Dataset(spark.range(1), None, [], 5, ())})
    monkeypatch.setattr(models.fc, "sample_grid", sample)
    with pytest.raises(Seen) as found:
        QUERIES["parameter_search"](spark, SF)
    assert found.value.args == (fc.GBT_GRID, 50)
