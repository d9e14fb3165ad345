"""Forecasting features, data sets, models and reports for sampled signals on Spark."""

from linkcast.config import Config, FeatureConfig, SignalConfig, SplitConfig, ValidationConfig

__all__ = ["Config", "FeatureConfig", "SignalConfig", "SplitConfig", "ValidationConfig"]
