"""Whitening against numpy on centred whole numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkcast.llm import whitening
from linkcast.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def run(spark, vecs, ids=None, most=32):
    table = spark.createDataFrame(list(zip(ids or range(len(vecs)), vecs)), SCHEMA)
    for name in ("n", "d", "component", "at"):
        table = table.withColumn(name, F.lit("x"))
    rows, d = whitening.vectors(table.repartition(3))
    return rows, d, whitening.fit(rows, d, most)


def brute(vecs):
    x = np.floor(64 * np.array(vecs, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n = len(x)
    centred = ((n * x.astype(object) - x.sum(axis=0).astype(object)) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, centred, values[::-1], axes.T[::-1]


@pytest.mark.parametrize("n, d, seed", [(400, 8, 1), (60, 40, 2), (9, 3, 3)])
def test_matches_numpy(spark, n, d, seed):
    rng = np.random.default_rng(seed)
    vecs = (rng.normal(size=(n, d)) * np.geomspace(40, 0.5, d)).astype(np.float32).tolist()
    rows, got_d, model = run(spark, vecs)
    x, centred, values, axes = brute(vecs)
    k = min(32, d)
    assert got_d == d and model.n == n and len(model.components) == k
    assert np.allclose(model.eigenvalues, values[:k], rtol=1e-9)
    assert model.total == pytest.approx(values.sum(), rel=1e-12)
    assert np.allclose(np.abs((model.components * axes[:k]).sum(axis=1)), 1, atol=1e-10)
    assert whitening.identity_error(rows, d, model) < 1e-10
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    for r in whitening.whiten(rows, d, model).collect():
        assert r.deviation == deviation[r.vec_id]
        want = centred[r.vec_id] @ model.components[r.component - 1] / np.sqrt(values[r.component - 1])
        assert r.whitened == pytest.approx(want, abs=1e-9)


def test_dropped_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], [0.5, 0.25]]
    vecs = [*good, None, [], [1.0, None], [nan, 1.0], [1.0, inf], [-inf, 1.0], [1.0, 2.0, 3.0], [1.0]]
    ids = [5, None, 7, 7, *range(20, 28)]
    rows, d, model = run(spark, vecs, ids)
    assert d == 2 and model.n == 4
    found = whitening.whiten(rows, d, model).collect()
    assert sorted((r.vec_id for r in found), key=str) == sorted([5, 5, None, None, 7, 7, 7, 7], key=str)
    assert len({(r.deviation, r.component, round(r.whitened, 9)) for r in found if r.vec_id == 7}) == 2


@pytest.mark.parametrize("vecs", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 4])
def test_no_variance_gives_no_rows(spark, vecs):
    rows, d, model = run(spark, vecs)
    assert model is None and whitening.whiten(rows, d, model).count() == 0


def test_constant_and_dependent_columns(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-50, 50, (80, 3)).astype(float)
    vecs = np.column_stack([base, base[:, 0], np.full(80, 7.0), base[:, 1] + base[:, 2]]) * 2
    rows, d, model = run(spark, vecs.tolist())
    assert len(model.components) == 3
    assert np.allclose(model.eigenvalues, brute(vecs)[2][:3], rtol=1e-9)
    assert whitening.identity_error(rows, d, model) < 1e-9


def test_fewer_rows_than_dimensions(spark):
    vecs = np.random.default_rng(5).normal(size=(6, 20)).astype(np.float32)
    rows, d, model = run(spark, vecs.tolist())
    assert len(model.components) == 5
    assert np.allclose(model.eigenvalues, brute(vecs)[2][:5], rtol=1e-8)


def test_badly_conditioned_columns(spark):
    """Deviations of 2 ** 28 and of 1 in one table, along mixed axes; a covariance would lose the small ones."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 1)) * 4e6
    vecs = np.column_stack([base, base + rng.normal(size=(300, 1)) * 2, rng.normal(size=(300, 1))]).astype(np.float32)
    rows, d, model = run(spark, vecs.tolist())
    x, centred, *_ = brute(vecs)
    sigma = np.linalg.svd(centred, compute_uv=False)
    assert np.allclose(np.sqrt(model.eigenvalues * 300), sigma, rtol=1e-6)
    assert whitening.identity_error(rows, d, model) < 1e-4


def test_deviation_beyond_a_long_is_null():
    x = np.array([[2**40, 0], [3, 4]])
    sums = np.array([2**41, 0], object)
    assert whitening.deviations(x, 2**30, sums) == [None, None]
    assert whitening.deviations(x[1:], 2, np.array([5, 9], object)) == [1 + 1]


def test_query(spark):
    found = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").collect()
    vecs = {r.vec_id for r in found}
    assert len(found) == 32 * len(vecs) == 32 * spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert {r.n for r in found} == {len(vecs)} and max(r.identity_error for r in found) < 1e-9
    order = sorted({(r.component, r.explained) for r in found})
    assert [e for _, e in order] == sorted((e for _, e in order), reverse=True)
