"""Feature sets, splits, scaling and validation."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from conftest import by_series
from pyspark.sql import functions as F

from linkcast.config import Config, SignalConfig, SplitConfig
from linkcast.operators.quantiles import quantiles
from linkcast.operators.sequences import (
    label_sequences, make_sequences, sequence_split, sequence_stats,
)
from linkcast.operators.splits import apply_scaler, fit_scaler, ratio_split
from linkcast.operators.stats import autocorrelation, qq_points, validate
from linkcast.plans.dataset import prepare
from linkcast.plans.features import engineer_features, feature_names, register_feature, wide_features
from linkcast.plans.forecast import fit, metrics, scored_levels
from linkcast.sources.signals import load_signal

RNG = np.random.default_rng(3)
BASE = Config(base="x", signal=SignalConfig(max_samples=None), split=SplitConfig(min_train_samples=0))


def table(spark, series):
    return spark.createDataFrame(
        pd.concat([pd.DataFrame({"series": k, "t": range(len(v)), "p": v}) for k, v in series.items()])
    )


def test_full_feature_set(make_signal):
    sig = make_signal({"a": RNG.normal(size=400)})
    df = engineer_features(sig, 5, BASE)
    assert len(df.columns) - 2 == 52  # besides series and seq
    assert len(feature_names(BASE, 5)) == 48
    assert df.count() == 400 - 15
    assert df.toPandas().notna().all().all()


def test_flags(make_signal):
    cfg = BASE.with_features(enable_lags=False, enable_acf=False, enable_spectral=False, horizons=(5,))
    names = feature_names(cfg, 5)
    assert not [n for n in names if "lag" in n or "spectral" in n]
    assert set(names) <= set(wide_features(make_signal({"a": RNG.normal(size=120)}), cfg).columns)


def test_levels_as_lags_keep_all_but_the_target_lag():
    names = feature_names(BASE.with_features(use_diff=False), 5)
    assert "x_lag5" not in names and "x_lag6" in names


def test_custom_family(make_signal):
    class Doubled:
        def reach(self):
            return 0, 0

        def names(self):
            return ["x_doubled"]

        def levels(self, f):
            return [{"x_doubled": F.col("x") * 2}]

    register_feature("doubled", lambda cfg: Doubled())
    cfg = BASE.with_features(custom=("doubled",), enable_spectral=False, enable_acf=False)
    got = engineer_features(make_signal({"a": RNG.normal(size=80)}), 5, cfg).toPandas()
    assert (got.x_doubled == 2 * got.x).all()
    with pytest.raises(ValueError):
        feature_names(cfg.with_features(custom=("nothing",)), 5)


def test_split_order_and_minimum(make_signal):
    sig = make_signal({"a": range(1000), "b": range(37)})
    df = ratio_split(sig.df, ["series"], BASE.split, sig.n_series).toPandas()
    for _, g in df.groupby("series"):
        n = len(g)
        sizes = [int(n * 0.7), int(n * 0.15)]
        assert (g.split == "train").sum() == sizes[0] and (g.split == "val").sum() == sizes[1]
        assert g[g.split == "train"].seq.max() < g[g.split == "val"].seq.min()
        assert g[g.split == "val"].seq.max() < g[g.split == "test"].seq.min()
    with pytest.raises(ValueError, match="training rows"):
        ratio_split(sig.df, ["series"], SplitConfig(min_train_samples=100), sig.n_series)
    with pytest.raises(ValueError):
        SplitConfig(train_ratio=0.9)


def test_tiny_series_keep_their_rows(make_signal):
    sig = make_signal({"a": [1.0], "b": [1.0, 2.0, 3.0]})
    df = ratio_split(sig.df, ["series"], BASE.split, sig.n_series)
    assert df.count() == 4


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_scaler_uses_training_rows_only(make_signal, method):
    x = RNG.normal(size=500)
    params = []
    for tail in (0.0, 100.0):
        y = x.copy()
        y[400:] += tail
        sig = make_signal({"a": y})
        df = ratio_split(sig.df, ["series"], BASE.split, 1)
        params.append(fit_scaler(df, ["series"], ["x"], method).toPandas())
    pd.testing.assert_frame_equal(*params)
    with pytest.raises(ValueError):
        fit_scaler(df, ["series"], ["x"], "other")


def test_constant_columns_scale_by_one(make_signal):
    sig = make_signal({"a": np.full(50, 4.0)})
    df = ratio_split(sig.df, ["series"], BASE.split, 1)
    scaled = apply_scaler(df, ["series"], ["x"], fit_scaler(df, ["series"], ["x"]), 1)
    assert (scaled.toPandas().x == 0).all()


def test_validation(spark):
    bad = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (4.0,), (float("inf"),), (None,)], "v double")
    with pytest.raises(ValueError, match="v has 2 missing values, v has 1 infinite values"):
        validate(bad, ["v"])
    with pytest.raises(ValueError, match="no rows"):
        validate(bad.where("v > 1e9 and v < 1e8"), ["v"])
    assert validate(bad.where("v < 3"), ["v"])["n_rows"] == 2


def test_nonpositive_power(spark):
    df = table(spark, {"a": [1.0, 0.0, 2.0]})
    from linkcast.sources.signals import load_signal

    with pytest.raises(Exception, match="positive"):
        load_signal(df, "p", ["t"], ["series"], BASE).df.collect()
    drop = replace(BASE, signal=replace(BASE.signal, nonpositive="drop"))
    assert load_signal(df, "p", ["t"], ["series"], drop).df.count() == 2
    null = replace(BASE, signal=replace(BASE.signal, nonpositive="null"))
    assert load_signal(df, "p", ["t"], ["series"], null).df.where("x is null").count() == 1


@pytest.mark.parametrize("availability", ["asof", "current"])
def test_white_noise(spark, availability):
    """With values known at the forecast only, noise cannot be predicted."""
    cfg = replace(
        BASE.with_features(
            horizons=(5, 50), availability=availability, enable_acf=False, enable_spectral=False
        ),
        signal=replace(BASE.signal, max_samples=None),
    )
    df = table(spark, {"a": RNG.normal(size=6000)})
    sets = prepare(df, "p", ["t"], ["series"], cfg, to_db=False).sets
    for h, ds in sets.items():
        scored = scored_levels(fit("linear", ds).score(ds.part("test")))
        diff = metrics(scored, ["split"]).first().r2
        level = metrics(scored, ["split"], "level", "predicted_level").first().r2
        if availability == "asof":
            assert abs(diff - 0.5) < 0.06 and abs(level) < 0.06
        else:
            assert diff > 0.9  # the known leak of features that see the target


def test_prepared_sets(spark):
    cfg = BASE.with_features(horizons=(5, 20), enable_spectral=False)
    prep = prepare(table(spark, {"a": np.exp(RNG.normal(size=900)), "b": np.exp(RNG.normal(size=600))}), "p", ["t"], ["series"], cfg)
    assert set(prep.sets) == {5, 20} and prep.metadata.count() == 2
    for h, ds in prep.sets.items():
        train = ds.part("train").toPandas()
        assert abs(train.groupby("series")[ds.features[0]].mean()).max() < 1e-9
        np.testing.assert_allclose(train.level - train.level_lag, train.y, atol=1e-12)
        assert ds.df.count() == 1500 - 2 * (h + 10)
        assert set(ds.scaler.toPandas().feature) == set(ds.features)


def test_sequences_against_numpy(make_signal):
    x = RNG.normal(size=300)
    sig = make_signal({"a": x})
    got = by_series(make_sequences(sig, 20, 10, False, "x"), "a")
    assert len(got) == 300 - 30 + 1
    assert all(np.array_equal(got.X[i], x[i : i + 20]) and got.y[i] == x[i + 29] for i in (0, 7, 270))
    ahead = by_series(make_sequences(sig, 20, 10, True, "x"), "a")
    assert np.array_equal(ahead.y[3], x[23:33])
    bounds = sequence_split(sig, 20, 10)
    n_train = int(271 * 0.7)
    want = np.stack([x[i : i + 20] for i in range(n_train)])
    std = sequence_stats(sig, bounds, 20, "standard", "x").first()
    np.testing.assert_allclose([std.center, std.scale], [want.mean(), want.std()])
    rng = sequence_stats(sig, bounds, 20, "minmax", "x").first()
    np.testing.assert_allclose([rng.center, rng.scale], [want.min(), np.ptp(want)])
    purged = sequence_split(sig, 20, 10, purge=30)
    split = label_sequences(make_sequences(sig, 20, 10, False, "x"), purged, ["series"], 1).toPandas()
    assert split[split.split == "train"].seq.max() + 30 <= split[split.split == "val"].seq.min()


def test_quantiles_by_rank_equal_numpy(make_signal):
    x, y = RNG.normal(size=333), RNG.normal(size=50)
    sig = make_signal({"a": x, "b": y})
    for limit in (0, 10**6):
        got = {r.series: r.q for r in quantiles(sig.df, ["series"], ["x"], (0.0, 0.1, 0.5, 1.0), limit).collect()}
        np.testing.assert_allclose(got["a"], np.percentile(x, [0, 10, 50, 100]))
        np.testing.assert_allclose(got["b"], np.percentile(y, [0, 10, 50, 100]))


def test_autocorrelation_against_numpy(make_signal):
    x = np.cumsum(RNG.normal(size=400))
    got = autocorrelation(make_signal({"a": x, "b": x[:30]}), "x", 40).toPandas()
    for name, v in (("a", x), ("b", x[:30])):
        g = got[got.series == name].set_index("lag").acf
        for k in range(1, min(40, len(v) - 2)):
            np.testing.assert_allclose(g[k], np.corrcoef(v[:-k], v[k:])[0, 1], atol=1e-9)


def test_normal_plot(make_signal):
    from statistics import NormalDist

    got = qq_points(make_signal({"a": RNG.normal(size=1000)}), "x", 100).toPandas().sort_values("rank")
    assert len(got) == 10 and got.observed.is_monotonic_increasing
    np.testing.assert_allclose(got.theoretical.iloc[0], NormalDist().inv_cdf(1 - 0.5**0.1))


def test_null_keys_keep_their_rows(spark):
    """Short and long indexing give the same rows, of a series without a name as well."""
    rows = [(None if k % 2 else "a", k, float(k % 7)) for k in range(40)] + [("b", 1, float("nan")), ("b", 2, None)]
    df = spark.createDataFrame(rows, "series string, t long, watts double")
    cfg = replace(BASE, signal=replace(BASE.signal, center="all"))
    found = []
    for how in ({}, {"short_series": 0, "range_rows": 5}):
        sig = load_signal(df, "watts", ["t"], ["series"], cfg, to_db=False, **how)
        found.append(sorted((tuple(r) for r in sig.df.select("series", "seq", "x").collect()), key=str))
    assert found[0] == found[1] and len(found[0]) == 42
    assert sum(r[0] is None for r in found[0]) == 20 and [r[2] for r in found[0] if r[0] == "b"] == [None, None]


def test_validation_names_the_columns(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), float("inf"))], "a double, b double")
    with pytest.raises(ValueError, match="a has 1 missing values, b has 1 missing values, b has 1 infinite"):
        validate(df, ["a", "b"])


def test_naive_sweep_writes_no_inputs(make_signal):
    """The rows are those of the full sweep; the ten lags of each are left out of the written table."""
    from linkcast.catalog.common import CFG
    from linkcast.plans import precompensation as pre

    sig = make_signal({"a": np.sin(np.arange(200) / 7.0), "b": np.arange(90) ** 0.5})
    whole = pre.sweep_rows(sig, (1, 5, 20), 40, CFG)
    narrow = pre.sweep_rows(sig, (1, 5, 20), 40, CFG, inputs=False)
    assert set(narrow.columns) == {"series", "horizon", "seq", "split", "level", "level_lag", "y"}
    both = [pre.naive_residuals(df, ["series"]).orderBy("latency", "series", "seq").collect() for df in (whole, narrow)]
    assert both[0] == both[1] and len(both[0]) > 300


def test_sets_of_several_horizons_are_read_from_the_wide_table(spark, make_signal, monkeypatch):
    """Only points and scaler are written, and the rows are those of the written sets."""
    from linkcast.plans import dataset

    sig = make_signal({"a": RNG.normal(size=400), "b": RNG.normal(size=300)})
    cfg = BASE.with_features(
        horizons=(5, 20), availability="asof", enable_acf=False, enable_spectral=False, rolling_windows=(5,),
    )
    wide = dataset.stage(dataset.wide_features(sig, cfg), "features")
    rows, _ = dataset.stacked_sets(sig, wide, cfg)
    written = []
    stage = dataset.stage
    monkeypatch.setattr(dataset, "stage", lambda df, name, *a: (written.append(name), stage(df, name, *a))[1])
    sets = dataset.read_sets(sig, wide, cfg)
    assert sorted(written) == ["points", "scaler"]
    for h in (5, 20):
        want = dataset.one_set(rows, None, sig, h, cfg).df.orderBy("series", "seq").toPandas()
        pd.testing.assert_frame_equal(sets[h].df.orderBy("series", "seq").toPandas(), want)
        assert sets[h].scaler.count() == 2 * len(sets[h].features)
