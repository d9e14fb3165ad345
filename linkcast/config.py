"""Frozen settings for signal preparation, features, splits and validation."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# The defaults a user of the feature set expects.
HORIZONS = (5, 50, 100, 200, 500)
SWEEP_LATENCIES = (1, 5, 10, 15, 20, 25, 30, 35, 40, 50)
ROLLING_WINDOWS = (5, 10, 20, 50)
ROLLING_STATS = ("mean", "std", "min", "max")
EMA_ALPHAS = (0.1, 0.3, 0.5)
ACF_LAGS = (1, 5, 10, 20)
BASELINE_RMSE = 0.2234
CONDITIONS = ("strong", "moderate", "weak")


# The numbers below are fixed values as well.
@dataclass(frozen=True)
class SignalConfig:
    sampling_rate: int = 10_000
    max_samples: int | None = None  # a number keeps that many first samples of a series
    nonpositive: str = "error"  # error | null | drop
    center: str = "all"  # all | train | none


@dataclass(frozen=True)
class FeatureConfig:
    horizons: tuple[int, ...] = HORIZONS
    n_taps: int = 10
    use_diff: bool = True
    enable_lags: bool = True
    enable_rolling: bool = True
    rolling_windows: tuple[int, ...] = ROLLING_WINDOWS
    rolling_stats: tuple[str, ...] = ROLLING_STATS
    enable_ema: bool = True
    ema_alphas: tuple[float, ...] = EMA_ALPHAS
    enable_acf: bool = True
    acf_lags: tuple[int, ...] = ACF_LAGS
    acf_window: int = 100
    acf_mode: str = "wrapped"  # wrapped | valid
    enable_spectral: bool = True
    fft_window: int = 100
    n_top_frequencies: int = 5
    enable_trend: bool = True
    trend_window: int = 50
    custom: tuple[str, ...] = ()  # names from the feature registry
    availability: str = "current"  # current | asof

    def __post_init__(self):
        if self.availability not in ("current", "asof"):
            raise ValueError(f"unknown availability: {self.availability}")
        if not self.horizons or min(self.horizons) < 1:
            raise ValueError("horizons must be positive")


@dataclass(frozen=True)
class SplitConfig:
    train_ratio: float = 0.70
    val_ratio: float = 0.15
    test_ratio: float = 0.15
    min_train_samples: int = 50_000

    def __post_init__(self):
        total = self.train_ratio + self.val_ratio + self.test_ratio
        if abs(total - 1.0) > 1e-9:
            raise ValueError(f"split ratios add up to {total}, not 1")


@dataclass(frozen=True)
class ValidationConfig:
    check_nan: bool = True
    check_inf: bool = True
    check_empty: bool = True


@dataclass(frozen=True)
class Config:
    base: str = "OptPow"
    signal: SignalConfig = field(default_factory=SignalConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    validation: ValidationConfig = field(default_factory=ValidationConfig)
    scaling: str | None = "standard"  # standard | minmax | robust | None

    def with_features(self, **changes) -> "Config":
        return replace(self, features=replace(self.features, **changes))

    def with_split(self, **changes) -> "Config":
        return replace(self, split=replace(self.split, **changes))

    def latency_ms(self, samples: int) -> float:
        return samples / self.signal.sampling_rate * 1000
