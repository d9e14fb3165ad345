"""Feature sets: all families from one configuration, for one or many horizons.

Most features do not depend on the horizon. They are computed once in a wide
table that also holds every horizon's lags and target; ``horizon_view`` picks
the columns of one horizon and ``long_form`` stacks all horizons.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcast.config import Config
from linkcast.functions.scalar import is_missing
from linkcast.operators.ordering import Signal
from linkcast.operators.spectrum import Spectrum
from linkcast.operators.windows import Diff, Ema, Lags, Rolling, RollingAcf, Targets, Trend, add_features

CustomFeature = Callable[[Config], object]
_REGISTRY: dict[str, CustomFeature] = {}


def register_feature(name: str, make: CustomFeature) -> None:
    """Add a feature family; ``FeatureConfig.custom`` switches it on by name.

    ``make(cfg)`` returns an object with ``reach()``, ``names()`` and
    ``levels(frame)`` like the families in ``operators.windows``.
    """
    _REGISTRY[name] = make


def shared_families(cfg: Config):
    f, base = cfg.features, cfg.base
    asof = f.availability == "asof"
    out = []
    if f.enable_rolling:
        out.append(Rolling(f.rolling_windows, f.rolling_stats, 1, base))
    if f.enable_ema:
        out.append(Ema(f.ema_alphas, False, base))
    if f.enable_acf:
        out.append(RollingAcf(f.acf_lags, f.acf_window, f.acf_mode, base))
    if f.enable_trend:
        out.append(Trend(f.trend_window, asof, base))
    for name in f.custom:
        if name not in _REGISTRY:
            raise ValueError(f"unknown feature family: {name}")
        out.append(_REGISTRY[name](cfg))
    return out


def spectrum_family(cfg: Config) -> Spectrum | None:
    f = cfg.features
    if not f.enable_spectral:
        return None
    return Spectrum(f.fft_window, f.n_top_frequencies, cfg.signal.sampling_rate, cfg.base)


def shared_names(cfg: Config) -> list[str]:
    names = [n for fam in shared_families(cfg) for n in fam.names()]
    spec = spectrum_family(cfg)
    return names[:_spectral_slot(cfg)] + (spec.names() if spec else []) + names[_spectral_slot(cfg):]


def _spectral_slot(cfg: Config) -> int:
    """The spectrum is listed after the autocorrelation, before the trend."""
    early = (Rolling, Ema, RollingAcf)
    return sum(len(fam.names()) for fam in shared_families(cfg) if isinstance(fam, early))


def feature_names(cfg: Config, horizon: int) -> list[str]:
    """Model inputs of one horizon, without the level, its difference and targets."""
    return [*_tap_sources(cfg, horizon), *shared_names(cfg)]


def _tap_sources(cfg: Config, horizon: int) -> dict[str, str]:
    """Lag features of a horizon and the columns of the wide table they come from."""
    f = cfg.features
    if not f.enable_lags:
        return {}
    lags = lambda start: Lags(tuple(range(start, start + f.n_taps)), f.use_diff, cfg.base).names()
    pairs = zip(lags(horizon), lags(0 if f.availability == "asof" else horizon))
    # The lag that rebuilds the level is no input where both would share a name.
    return {n: src for n, src in pairs if n != f"{cfg.base}_lag{horizon}"}


def wide_features(sig: Signal, cfg: Config = Config()) -> DataFrame:
    """All features and the lags and targets of every horizon, one row per sample."""
    f, base = cfg.features, cfg.base
    asof = f.availability == "asof"
    families = [Diff(base)] if f.use_diff else []
    if f.enable_lags:
        starts = (0,) if asof else f.horizons
        lags = sorted({h + j for h in starts for j in range(f.n_taps)})
        if not f.use_diff and not asof:
            # Targets adds the levels at the horizons themselves.
            lags = [k for k in lags if k not in f.horizons]
        families.append(Lags(tuple(lags), f.use_diff, base))
    families += [Targets(f.horizons, asof, base), *shared_families(cfg)]
    return add_features(sig, families, spectrum_family(cfg), [base])


def horizon_view(wide: DataFrame, keys, horizon: int, cfg: Config = Config()) -> DataFrame:
    """Columns of one horizon: keys, seq, level, difference, features, lag, target.

    In ``asof`` mode a wide row is the time of the forecast; here ``seq`` and the
    level belong to the predicted sample, as in ``current`` mode.
    """
    f, base = cfg.features, cfg.base
    lag, target = f"{base}_lag{horizon}", f"target_{horizon}"
    diff = [f"{base}_diff"] if f.use_diff else []
    if f.availability == "current":
        return wide.select(*keys, "seq", base, *diff, *feature_names(cfg, horizon), lag, target)
    taps = _tap_sources(cfg, horizon)
    return wide.where(F.col(target).isNotNull()).select(
        *keys,
        (F.col("seq") + horizon).alias("seq"),
        (F.col(base) + F.col(target)).alias(base),
        *[F.col(src).alias(name) for name, src in taps.items()],
        *shared_names(cfg),
        F.col(base).alias(lag),
        target,
    )


def complete_rows(view: DataFrame) -> DataFrame:
    """Rows without a missing number in any column."""
    numbers = [c for c, t in view.dtypes if t == "double"]
    return view.na.drop(subset=numbers)


def dropped_rows(view: DataFrame, keys) -> DataFrame:
    """Rows, complete rows and incomplete rows per series."""
    numbers = [c for c, t in view.dtypes if t == "double"]
    bad = is_missing(numbers[0])
    for c in numbers[1:]:
        bad = bad | is_missing(c)
    return view.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count_if(~bad).alias("n_kept"),
        F.count_if(bad).alias("n_dropped"),
    )


def engineer_features(sig: Signal, horizon: int, cfg: Config = Config()) -> DataFrame:
    """The feature table of one horizon, complete rows only."""
    one = cfg.with_features(horizons=(horizon,))
    return complete_rows(horizon_view(wide_features(sig, one), sig.keys, horizon, one))


def long_form(wide: DataFrame, keys, cfg: Config = Config()) -> DataFrame:
    """All horizons stacked: horizon, seq, level, shared features, taps, lag, target.

    Lags are named by their distance from the forecast (``tap0`` is the newest).
    """
    f, base = cfg.features, cfg.base
    asof = f.availability == "asof"
    entries = []
    for h in f.horizons:
        taps = _tap_sources(cfg, h).values()
        shift = h if asof else 0
        lag = F.col(base) if asof else F.col(f"{base}_lag{h}")
        entries.append(
            F.struct(
                F.lit(h).alias("horizon"),
                (F.col("seq") + shift).alias("seq"),
                (F.col(base) + F.col(f"target_{h}") if asof else F.col(base)).alias(base),
                *[F.col(t).alias(f"tap{i}") for i, t in enumerate(taps)],
                lag.alias("level_lag"),
                F.col(f"target_{h}").alias("target"),
            )
        )
    shared = shared_names(cfg)
    return wide.select(*keys, *shared, F.inline(F.array(*entries)))
