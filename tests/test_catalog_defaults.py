"""Model queries without SQL run the operators' defaults."""

import pytest
from conftest import SF

from linkcast.catalog import QUERIES, models
from linkcast.config import HORIZONS, SWEEP_LATENCIES, FeatureConfig


class Seen(Exception):
    pass


ONE = (5,)


@pytest.mark.parametrize("name, horizons", [
    *[(n, ONE) for n in (
        "linear_regression", "random_forest", "gradient_boosting", "feature_importance", "importance_csv", "batch_scoring",
        "error_by_trees", "parameter_search",
    )],
    ("train_horizons", HORIZONS), ("evaluation_matrix", HORIZONS), ("horizon_summary", HORIZONS),
])
def test_all_families_of_the_horizons_fitted(spark, monkeypatch, name, horizons):
    def prepare(df, value, order, keys, cfg, **_):
        raise Seen(cfg.features)

    monkeypatch.setattr(models, "prepare", prepare)
    with pytest.raises(Seen) as found:
        QUERIES[name](spark, SF)
    assert found.value.args[0] == FeatureConfig(availability="asof", horizons=horizons)


@pytest.mark.parametrize("name", ["random_forest", "gradient_boosting", "error_by_trees"])
def test_default_trees(spark, monkeypatch, name):
    def fit(kind, ds, params=None, seed=42):
        raise Seen(params)

    monkeypatch.setattr(models, "sets", lambda *_, **__: {5: None})
    monkeypatch.setattr(models.fc, "fit", fit)
    with pytest.raises(Seen) as found:
        QUERIES[name](spark, SF)
    assert not found.value.args[0]


def test_all_latencies(spark, monkeypatch):
    def rows(sig, latencies, *_):
        raise Seen(tuple(latencies))

    monkeypatch.setattr(models.pre, "sweep_rows", rows)
    with pytest.raises(Seen) as found:
        QUERIES["latency_sweep_models"](spark, SF)
    assert found.value.args[0] == SWEEP_LATENCIES
