"""Least squares from second moments against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkcast.plans.leastsquares import moments, predict, sequence_errors, solve

SCHEMA = "series string, split string, X array<double>, y array<double>"


def table(spark, n=400, p=4, q=3, offset=0.0, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + offset
    y = x @ rng.normal(size=(p, q)) + rng.normal(size=(n, q)) * 0.3 + 5
    series = np.array(["a", "b"])[rng.integers(0, 2, n)]
    split = np.array(["train", "val", "test"])[np.minimum(rng.integers(0, 6, n), 5) // 3 + (rng.random(n) < 0.2)]
    rows = list(zip(series.tolist(), split.tolist(), x.tolist(), y.tolist()))
    return spark.createDataFrame(rows, SCHEMA).repartition(5), x, y, series, split


def fitted(x, y):
    a = np.column_stack([np.ones(len(x)), x])
    return np.linalg.lstsq(a, y, rcond=None)[0]


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_solution_and_errors(spark, offset):
    df, x, y, series, split = table(spark, offset=offset)
    parts = moments(df, ["series", "split"])
    assert {k: m.n for k, m in parts.items()} == {
        (a, b): int(((series == a) & (split == b)).sum()) for a in "ab" for b in set(split)
    }
    train = split == "train"
    whole = parts["a", "train"] + parts["b", "train"]
    got = solve(whole)[0]
    centre = x[train].mean(axis=0)
    want = fitted(x[train] - centre, y[train])
    np.testing.assert_allclose(got.weights, want[1:], rtol=1e-6, atol=1e-9)
    residual = y - want[0] - (x - centre) @ want[1:]
    for (a, b), m in parts.items():
        mine = (series == a) & (split == b)
        np.testing.assert_allclose(got.squared_errors(m), (residual[mine] ** 2).sum(axis=0), rtol=1e-6)
    if not offset:
        found = predict(df.withColumn("prediction", F.lit("x")), got).select("y", "prediction").collect()
        e = np.array([r.y for r in found]) - np.array([r.prediction for r in found])
        np.testing.assert_allclose((e**2).sum(axis=0), (residual**2).sum(axis=0), rtol=1e-9)


def test_ridge_and_dependent_inputs(spark):
    df, x, y, *_ = table(spark, p=3)
    whole = moments(df, ["split"])["train",]
    plain, strong = solve(whole, (0.0, 1e6))
    assert np.abs(strong.weights).max() < 1e-4 < np.abs(plain.weights).max()
    np.testing.assert_allclose(strong.intercept, whole.centred()[0][3:], atol=1e-3)
    twice = df.withColumn("X", F.expr("concat(X, array(X[0], 1.0D))"))
    doubled = solve(moments(twice, ["split"])["train",])[0]
    np.testing.assert_allclose(doubled.weights[0] + doubled.weights[3], plain.weights[0], rtol=1e-8)
    np.testing.assert_allclose(doubled.weights[4], 0, atol=1e-9)


def test_errors_per_step_in_signal_units(spark):
    df, x, y, series, split = table(spark)
    scales = spark.createDataFrame([("a", 2.0), ("b", 5.0)], "series string, scale double")
    best, found = sequence_errors(df, "series", scales, (0.0, 0.1, 1e6))
    assert best.ridge < 1e6
    scale = np.where(series == "a", 2.0, 5.0)[:, None]
    e = (y - best.intercept - x @ best.weights) * scale
    for r in found.collect():
        mine = split == r.split
        np.testing.assert_allclose(r.rmse, np.sqrt((e[mine, r.step - 1] ** 2).mean()), rtol=1e-9)
        ys = (y * scale)[mine, r.step - 1]
        np.testing.assert_allclose(r.r2, 1 - (e[mine, r.step - 1] ** 2).sum() / ((ys - ys.mean()) ** 2).sum(), rtol=1e-9)
        assert r.n == mine.sum() and r.ridge == best.ridge
    assert found.count() == 9


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    scales = spark.createDataFrame([("a", 1.0)], "series string, scale double")
    assert moments(empty, ["split"]) == {}
    best, found = sequence_errors(empty, "series", scales)
    assert best is None and found.count() == 0
    only_test = spark.createDataFrame([("a", "test", [1.0], [2.0])], SCHEMA)
    assert sequence_errors(only_test, "series", scales)[1].count() == 0
    one = spark.createDataFrame([("a", "train", [1.0], [2.0])], SCHEMA)
    best, found = sequence_errors(one, "series", scales)
    assert best.intercept.tolist() == [2.0] and [(r.rmse, r.r2) for r in found.collect()] == [(0.0, None)]
