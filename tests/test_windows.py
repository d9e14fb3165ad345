"""Window features against numpy and pandas, and independence of the block size."""

import re

import numpy as np
import pandas as pd
import pytest
from conftest import by_series

from linkcast.operators import ordering
from linkcast.operators.spectrum import Spectrum
from linkcast.operators.windows import Diff, Ema, FastFading, Lags, Rolling, RollingAcf, Targets, Trend, add_features, slow_ema

RNG = np.random.default_rng(7)
LONG = np.cumsum(RNG.normal(size=1500))
ALL = [
    Lags((5, 6, 20), True, "x"), Diff("x"), Targets((5, 50), False, "x"), Rolling(base="x"),
    Ema(base="x"), RollingAcf(base="x"), Trend(base="x"),
]


@pytest.fixture(scope="module")
def signal(make_signal):
    sizes = (1, 2, 99, 100, 101)
    return make_signal({"long": LONG} | {f"n{n}": RNG.normal(size=n) for n in sizes})


@pytest.fixture(scope="module")
def plain(signal):
    return add_features(signal, ALL, Spectrum(base="x"), ["x"])


def frames(df):
    return df.toPandas().sort_values(["series", "seq"]).reset_index(drop=True)


def acf(x, lag, mode, n=100):
    out = np.zeros(len(x))
    for i in range(n, len(x)):
        w = x[i - n : i]
        a, b = (w[: n - lag], np.roll(w, lag)[: n - lag]) if mode == "wrapped" else (w[lag:], w[:-lag])
        if np.ptp(a) and np.ptp(b):
            out[i] = np.corrcoef(a, b)[0, 1]
    return out


@pytest.mark.parametrize("block_rows", [1, 512])
def test_blocks_equal_plain_windows(signal, plain, block_rows, monkeypatch):
    from linkcast.operators import ordering

    monkeypatch.setattr(ordering, "MIN_BLOCK_ROWS", 1)
    # A short reach makes the blocks small, so that series are really cut.
    families = [Lags((5, 6, 20), True, "x"), Rolling(base="x"), Trend(base="x"), Targets((5, 50), False, "x")]
    cut = add_features(signal.with_blocks(block_rows), families, keep=["x"])
    assert "_block" in cut._jdf.queryExecution().toString()
    a, b = frames(cut), frames(plain)
    for c in a.columns:
        if c == "series":
            continue
        np.testing.assert_allclose(a[c].to_numpy(), b[c].to_numpy(), rtol=1e-12, atol=1e-12, err_msg=c)


def test_ranges_equal_row_numbers(spark, make_signal):
    series = {"long": LONG, "b": RNG.normal(size=700)}
    short = make_signal(series)
    ranged = make_signal(series, short_series=10, range_rows=300)
    a, b = frames(short.df), frames(ranged.df)
    pd.testing.assert_frame_equal(a, b)
    assert list(by_series(ranged.df, "long").x) == list(LONG)


def test_rolling_and_trend(plain):
    got, x = by_series(plain, "long"), pd.Series(LONG)
    for w in (5, 10, 20, 50):
        roll = x.rolling(w, min_periods=1)
        for s in ("mean", "std", "min", "max"):
            np.testing.assert_allclose(got[f"x_rolling_{s}_{w}"], getattr(roll, s)(), atol=1e-9)
    trend = x.rolling(50, center=True, min_periods=1).mean()
    np.testing.assert_allclose(got.x_trend, trend, atol=1e-9)
    np.testing.assert_allclose(got.x_trend + got.x_residual, x, atol=1e-12)
    np.testing.assert_allclose(got.x_residual_std, (x - trend).rolling(50, min_periods=1).std(), atol=1e-9)


def test_centred_frame_bounds(make_signal):
    got = by_series(add_features(make_signal({"a": np.arange(200)}), [Trend(base="x")]), "a")
    assert got.x_trend[100] == np.mean(np.arange(75, 125))


@pytest.mark.parametrize("alphas", [(0.1, 0.3, 0.5), (0.05, 0.9, 1.0)])
@pytest.mark.parametrize("adjust", [False, True])
def test_ema(signal, alphas, adjust):
    got = by_series(add_features(signal, [Ema(alphas, adjust, "x")]), "long")
    for a in alphas:
        want = pd.Series(LONG).ewm(alpha=a, adjust=adjust).mean()
        np.testing.assert_allclose(got[f"x_ema_{str(a).replace('.', '_')}"], want, rtol=1e-10, atol=1e-10)


@pytest.mark.parametrize("adjust", [False, True])
def test_slow_ema(signal, adjust):
    got = by_series(slow_ema(signal, (0.002, 0.3), adjust, "x", 100), "long")
    for a in (0.002, 0.3):
        want = pd.Series(LONG).ewm(alpha=a, adjust=adjust).mean()
        np.testing.assert_allclose(got[f"x_ema_{str(a).replace('.', '_')}"], want, rtol=1e-9, atol=1e-9)
    with pytest.raises(ValueError, match="slow_ema"):
        add_features(signal, [Ema((1e-6,), adjust, "x")])


def test_ema_of_a_constant(make_signal):
    got = add_features(make_signal({"a": np.full(900, 3.5)}), [Ema(base="x")]).toPandas()
    np.testing.assert_allclose(got.filter(like="ema"), 3.5, rtol=1e-13)


@pytest.mark.parametrize("mode", ["wrapped", "valid"])
def test_autocorrelation(make_signal, mode):
    x = LONG.copy()
    x[600:800] = x[600]  # windows without variance
    got = by_series(add_features(make_signal({"a": x}), [RollingAcf(mode=mode, base="x")]), "a")
    for k in (1, 5, 10, 20):
        np.testing.assert_allclose(got[f"x_acf_lag{k}"], acf(x, k, mode), atol=1e-7)


def test_spectrum(plain):
    got = by_series(plain, "long")
    for i in (100, 101, 700, 1499):
        power = np.abs(np.fft.rfft(LONG[i - 100 : i] * np.hanning(100))) ** 2
        freqs = np.fft.rfftfreq(100, 1e-4)
        row = got.iloc[i]
        np.testing.assert_allclose(row.x_spectral_power_total, power.sum())
        np.testing.assert_allclose(row.x_spectral_centroid, (freqs * power).sum() / power.sum())
        best = np.argsort(-power, kind="stable")[:5]
        np.testing.assert_allclose([row[f"x_spectral_freq{j + 1}"] for j in range(5)], freqs[best])
        np.testing.assert_allclose([row[f"x_spectral_power{j + 1}"] for j in range(5)], power[best])
    spectral = got.filter(like="spectral")
    assert (spectral.iloc[:100] == spectral.iloc[100]).all().all()


def test_sine_peak(make_signal):
    sine = np.sin(2 * np.pi * 10 * np.arange(300) / 100)
    got = by_series(add_features(make_signal({"a": sine}), [], Spectrum(base="x")), "a")
    assert (got.x_spectral_freq1 == 1000).all()


def test_short_series_have_no_spectrum(plain):
    for n in (1, 2, 99, 100):
        assert by_series(plain, f"n{n}").filter(like="spectral").isna().all().all()
    assert by_series(plain, "n101").filter(like="spectral").notna().all().all()
    assert (by_series(plain, "n100").filter(like="acf") == 0).all().all()


@pytest.mark.parametrize("window", [1000, 7])
def test_fast_fading(make_signal, window):
    x = np.abs(LONG) + 1
    got = by_series(add_features(make_signal({"a": x}), [FastFading(window, "x")]), "a")
    want = [v / x[max(0, i - window // 2) : i + (window - 1) // 2 + 1].mean() for i, v in enumerate(x)]
    np.testing.assert_allclose(got.x_fading, want, rtol=1e-10)


@pytest.mark.parametrize("block_rows", [512, 32_768])
@pytest.mark.parametrize("mode", ["wrapped", "valid"])
def test_a_missing_value_reaches_its_windows_only(make_signal, mode, block_rows):
    x = RNG.normal(size=2000)
    x[700] = np.nan
    sig = make_signal({"a": x}, block_rows=block_rows)
    got = by_series(add_features(sig, [RollingAcf((1, 5), mode=mode, base="x"), FastFading(100, "x")], keep=["x"]), "a")
    filled = np.where(np.isnan(x), 0, x)
    for lag in (1, 5):
        want = acf(filled, lag, mode)
        want[701:801] = 0
        np.testing.assert_allclose(got[f"x_acf_lag{lag}"], want, atol=1e-9)
    want = [v / np.nanmean(x[max(0, i - 50): i + 50]) for i, v in enumerate(x)]
    np.testing.assert_allclose(got.x_fading, want, rtol=1e-9)


def test_bad_arguments():
    with pytest.raises(ValueError):
        Rolling(stats=("median",))
    with pytest.raises(ValueError):
        Ema((0.0,))
    with pytest.raises(ValueError):
        RollingAcf((50,))


def test_range_partitions_do_not_grow_with_small_ranges(spark, monkeypatch):
    asked, inner = [], ordering._index_ranges
    monkeypatch.setattr(ordering, "_index_ranges", lambda *args: asked.append(args[-1]) or inner(*args))
    df = spark.range(3_000).selectExpr("'a' AS k", "id")
    sig = ordering.index_series(df, ["k"], ["id"], ["id"], short_series=0, range_rows=1)
    assert asked == [ordering.MAX_RANGES]
    assert sig.df.where("seq = id").count() == 3_000


def test_autocorrelation_looks_back_once_per_distance(make_signal):
    """Sums share their look backs, and later windows do not carry what only they need."""
    sig = make_signal({"a": np.arange(300.0) % 7})
    df = add_features(sig, [RollingAcf(base="x"), Trend(base="x"), Diff("x"), Rolling(base="x")])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window ")]
    reads = {c for line in windows for c in re.findall(r"AS (_acf_\w+_at\d+)#", line)}
    assert len([c for c in reads if c.startswith("_acf_sums_at")]) <= 13
    assert not [c for c in reads if re.match(r"_acf_[sqdzpw]\d*_at", c)]
    trend = next(i for i, line in enumerate(windows) if "AS x_trend#" in line)
    assert all("_acf_" not in line for line in windows[: trend + 1])
