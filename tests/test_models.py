"""Forecasters, search, reports, turbulence fits and sinks."""

import numpy as np
import pandas as pd
import pytest

from linkcast.functions.density import eddy_numbers, gammagamma_pdf, log_bessel_k
from linkcast.plans import forecast as fc
from linkcast.plans import reports
from linkcast.plans.dataset import Dataset
from linkcast.plans.turbulence import turbulence_strength
from linkcast.sources import sinks
from linkcast.sources.signals import read_conditions

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def linear_set(spark):
    n = 600
    X = RNG.normal(size=(n, 3))
    y = X @ [1.5, -2.0, 0.25] + 0.7 + 0.1 * RNG.normal(size=n)
    pdf = pd.DataFrame(X, columns=["f0", "f1", "f2"]).assign(
        y=y, seq=range(n), series="a", level=y, level_lag=0.0,
        split=["train"] * 400 + ["val"] * 100 + ["test"] * 100,
    )
    return Dataset(spark.createDataFrame(pdf), None, ["f0", "f1", "f2"], 5, ("series",)), X, y


def test_linear_equals_least_squares(linear_set):
    ds, X, y = linear_set
    fitted = fc.fit("linear", ds)
    want = np.linalg.lstsq(np.c_[X[:400], np.ones(400)], y[:400], rcond=None)[0]
    last = fitted.model.stages[-1]
    np.testing.assert_allclose([*last.coefficients, last.intercept], want, atol=1e-9)
    assert fitted.complexity == 4
    row = fc.results_row(fitted, ds).first()
    e = y[500:] - (X[500:] @ want[:3] + want[3])
    np.testing.assert_allclose(row.test_rmse, np.sqrt((e**2).mean()))
    np.testing.assert_allclose(row.test_r2, 1 - (e**2).sum() / ((y[500:] - y[500:].mean()) ** 2).sum())
    ranked = fc.importance(fitted, 5, ds.df.sparkSession).orderBy("rank").collect()
    assert [r.feature for r in ranked] == ["f1", "f0", "f2"]


def test_boosting_stops_and_saves(linear_set, tmp_path):
    ds, _, _ = linear_set
    fitted = fc.fit("gbt", ds, {"n_estimators": 4, "max_depth": 2, "early_stopping_rounds": 2})
    errors = [r.mse for r in fc.error_by_trees(fitted, ds.part("val")).orderBy("trees").collect()]
    assert len(errors) == 4 and np.allclose(errors, fitted.stage_errors)
    kept = fitted.model.stages[-1].getNumTrees
    assert kept == fc.best_tree_count(errors, 2)
    val = fitted.score(ds.part("val")).selectExpr("avg(pow(y - prediction, 2))").first()[0]
    np.testing.assert_allclose(val, errors[kept - 1])
    path = str(tmp_path / "model")
    sinks.save_model(fitted.model, path)
    again = sinks.load_model(path).transform(ds.part("test")).select("prediction").toPandas()
    first = fitted.score(ds.part("test")).select("prediction").toPandas()
    pd.testing.assert_frame_equal(first, again)


def test_the_first_trees_are_what_boosting_had(linear_set, tmp_path):
    """The same seed grows the same trees, so a short run equals the start of a long one."""
    ds, _, _ = linear_set
    long = fc.fit("gbt", ds, {"n_estimators": 6, "max_depth": 2, "early_stopping_rounds": 6})
    for n in (1, 3):
        short = fc.fit("gbt", ds, {"n_estimators": n, "max_depth": 2, "early_stopping_rounds": n})
        cut = fc.first_trees(long.grown, n)
        assert cut.getNumTrees == n and cut.numFeatures == 3
        vectors = long.model.stages[0].transform(ds.part("test"))
        one = cut.transform(vectors).select("prediction").toPandas()
        two = fc.first_trees(short.grown, n).transform(vectors).select("prediction").toPandas()
        pd.testing.assert_frame_equal(one, two)


def test_a_set_without_validation_rows_keeps_all_trees(linear_set):
    ds, _, _ = linear_set
    bare = Dataset(ds.df.where("split <> 'val'"), None, ds.features, 5, ds.keys)
    fitted = fc.fit("gbt", bare, {"n_estimators": 3, "max_depth": 2})
    assert fitted.model.stages[-1].getNumTrees == 3 and fitted.stage_errors == ()
    row = fc.results_row(fitted, bare).first()
    assert row.val_rmse is None and row.test_rmse > 0 and row.error is None


def test_failing_pairs_are_rows(linear_set):
    ds, _, _ = linear_set
    table = reports.evaluation_matrix({5: ds}, {"naive": {}, "linear": {"maxIter": -1}}).collect()
    assert {(r.model_name, r.test_rmse is None, r.error is None) for r in table} == {("Naive", False, True), ("linear", True, False)}
    none = Dataset(ds.df.where("split = 'test'"), None, ds.features, 7, ds.keys)
    done = fc.train_horizons({5: ds, 7: none}, "linear", [5, 7])
    assert done[7][0] is None and done[7][1].first().error == "no rows to train on" and done[5][1].first().error is None


def test_gbt_settings():
    assert fc.gbt_settings({"max_depth": None, "subsample": 0.8}) == {"maxDepth": 30, "subsamplingRate": 0.8}
    assert fc.gbt_settings({"colsample_bytree": 1.0})["featureSubsetStrategy"] == "all"
    with pytest.raises(ValueError):
        fc.gbt_settings({"reg_alpha": 1.0})


def test_grid_samples():
    points = fc.sample_grid(fc.GBT_GRID, 30, seed=1)
    assert len({tuple(p.items()) for p in points}) == 30
    assert points == fc.sample_grid(fc.GBT_GRID, 30, seed=1)
    assert len(fc.sample_grid({"a": [1, 2], "b": [3, 4]}, 50)) == 4
    assert len(fc.sample_draws({"a": [1, 2]}, 5)) == 5


def test_search_keeps_failures_as_rows(linear_set):
    ds, _, _ = linear_set
    best, trials = fc.tune("linear", ds, {"regParam": [0.0, 5.0], "maxIter": [10, -1]}, 10)
    assert best["regParam"] == 0.0 and trials.where("error IS NULL").count() == 2
    assert trials.where("error IS NOT NULL AND val_rmse IS NULL").count() == 2


def test_patience():
    rule = fc.PatienceRule(patience=2, min_delta=0.1)
    stops = [rule.stop_after(i, v) for i, v in enumerate([1.0, 0.95, 0.5, 0.45, 0.44])]
    assert stops == [False, False, False, False, True] and rule.best_step == 2
    up = fc.PatienceRule(patience=1, mode="max")
    assert [up.stop_after(i, v) for i, v in enumerate([1, 2, 2])] == [False, False, True]
    assert fc.best_tree_count([3.0, 2.0, 1.0, 1.5, 1.6, 0.1], patience=2) == 3
    with pytest.raises(ValueError):
        fc.PatienceRule(mode="other")


def test_unknown_names(linear_set):
    with pytest.raises(ValueError):
        fc.fit("nothing", linear_set[0])
    done = fc.train_horizons({5: linear_set[0]}, "naive", (5, 7))
    assert set(done) == {5}


@pytest.fixture(scope="module")
def results(spark):
    models = ["A", "B", "C", "D", "E", "F", "G", "H"]
    rows = []
    for i, m in enumerate(models):
        for j, h in enumerate((5, 50, 100, 200)):
            rmse = 0.18 + 0.01 * i + 0.005 * j * (1 + i % 3)
            rows.append((m, h, rmse * 0.9, rmse, rmse * 0.8, 1 - rmse, 0.1, rmse**2, float(i * 10), 0.01 * (8 - i), i))
    cols = ("model_name string, horizon int, train_rmse double, test_rmse double, test_mae double, test_r2 double, "
            "pred_variance double, residual_variance double, training_time double, "
            "inference_time_per_sample_ms double, model_complexity long")
    return spark.createDataFrame(rows, cols), pd.DataFrame(rows, columns=[c.split()[0] for c in cols.split(", ")])


def test_reports(results):
    df, pdf = results
    best = reports.best_overall(df).first()
    want = pdf.loc[pdf.test_rmse.idxmin()]
    assert (best.model_name, best.horizon) == (want.model_name, want.horizon)
    assert best.horizon_ms == best.horizon / 10
    per = {r.horizon: r.model_name for r in reports.best_per_horizon(df).collect()}
    assert per == {h: g.loc[g.test_rmse.idxmin()].model_name for h, g in pdf.groupby("horizon")}
    ranks = {r.model_name: r["rank"] for r in reports.rank_models(df).collect()}
    order = pdf.groupby("model_name").test_rmse.mean().sort_values().index
    assert ranks == {m: i + 1 for i, m in enumerate(order)}
    rec = {r.criterion: r for r in reports.recommendations(df).collect()}
    near = pdf[pdf.test_rmse <= pdf.test_rmse.min() * 1.1]
    assert rec["speed_accuracy"].model == near.loc[near.training_time.idxmin()].model_name
    assert rec["inference"].model == "H"
    assert rec["stability"].model == pdf.groupby("model_name").test_rmse.std().sort_values().index[0]
    assert reports.overall(df).first().horizons == [5, 50, 100, 200]
    table = reports.compare_models(df, baseline={5: 0.2, 50: 0.3, 100: 0.3, 200: 0.3}).toPandas()
    row = table[(table.model_name == "A") & (table.horizon == 5)].iloc[0]
    np.testing.assert_allclose(row.vs_baseline_pct, (0.2 - 0.18) / 0.2 * 100)


def test_rankings_keep_kinds_apart(results):
    from pyspark.sql import functions as F

    df, _ = results
    both = df.withColumn("target_kind", F.lit("level")).unionByName(df.withColumn("target_kind", F.lit("difference")))
    assert reports.best_overall(both).count() == 2
    assert reports.recommendations(both).count() == 8


def test_bessel_and_density():
    # K_0(1), K_1(2) and K_{1/2}(z) = sqrt(pi / 2z) e^-z
    np.testing.assert_allclose(np.exp(log_bessel_k(0.0, 1.0)), 0.42102443824070834, rtol=1e-10)
    np.testing.assert_allclose(np.exp(log_bessel_k(1.0, 2.0)), 0.13986588181652243, rtol=1e-10)
    z = np.array([0.01, 1.0, 50.0, 900.0])
    np.testing.assert_allclose(log_bessel_k(0.5, z), 0.5 * np.log(np.pi / (2 * z)) - z, rtol=1e-9)
    grid = np.linspace(1e-4, 12, 200_001)
    for s in (0.03, 0.1, 0.5):
        p = gammagamma_pdf(s, grid)
        np.testing.assert_allclose(np.trapezoid(p, grid), 1, rtol=1e-3)
        np.testing.assert_allclose(np.trapezoid(p * grid, grid), 1, rtol=1e-2)


def test_strength_recovery(make_signal):
    n = 30_000
    a, b = eddy_numbers(0.3)
    strong = RNG.gamma(a, 1 / a, n) * RNG.gamma(b, 1 / b, n)
    weak = np.exp(RNG.normal(-0.01, np.sqrt(0.02), n))
    got = {
        r.series: r
        for r in turbulence_strength(make_signal({"strong": strong, "weak": weak}), "x", bins=150, rounds=3).collect()
    }
    assert got["strong"].model == "gammagamma" and abs(got["strong"].strength - 0.3) < 0.06
    assert got["weak"].model == "lognormal" and abs(got["weak"].strength - 0.02) < 0.004


def test_condition_catalogue(spark, tmp_path):
    paths = {}
    for name in ("strong", "weak"):
        paths[name] = str(tmp_path / name)
        spark.createDataFrame([(0, 1.0), (1, 2.0)], "t long, p double").write.parquet(paths[name])
    assert read_conditions(spark, paths).count() == 4
    assert read_conditions(spark, paths, ["weak"]).select("series").distinct().first().series == "weak"
    with pytest.raises(ValueError, match="unknown condition"):
        read_conditions(spark, paths, ["calm"])


def test_top_features_by_weight(spark):
    df = spark.createDataFrame([("m", 5, "a", -9.0, 1), ("m", 5, "b", 0.1, 2)], "model string, horizon int, feature string, importance double, rank int")
    assert [tuple(r) for r in reports.top_features(df, 1).collect()] == [("m", 5, "a", -9.0, 1)]


def test_largest_metric_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([("b", 5, 0.9), ("a", 5, 0.9), ("c", 5, 0.1)], "model_name string, horizon int, test_r2 double")
    assert reports._best(df, [], "test_r2", largest=True).first().model_name == "a"


def test_naive_level_is_the_last_value(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0)], "x0 double, x1 double, y double")
    fitted = fc.FORECASTERS["naive"](Dataset(df, None, ["x0", "x1"], 1, (), "level"), {}, 1)
    assert fitted.score(df).first().prediction == 2.0


def test_tree_partitions_stop_at_the_cores(linear_set, spark, monkeypatch):
    """Each partition shuffles the statistics of all nodes: rows alone must not add partitions."""
    monkeypatch.setattr(fc, "TRAIN_ROWS", 10)
    with fc.training_vectors(linear_set[0]) as (_, rows):
        assert rows.count() == 400
        assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
