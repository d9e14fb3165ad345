"""Power left after subtracting a forecast, over a range of latencies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcast.config import SWEEP_LATENCIES, Config
from linkcast.operators.ordering import Signal
from linkcast.operators.splits import count_split
from linkcast.plans.dataset import Dataset, one_set, stacked_sets
from linkcast.plans.features import wide_features
from linkcast.plans.forecast import fit, scored_levels
from linkcast.session import stage

FILL = -9999.0  # fixed value for gaps in exported residuals


def lag_config(latencies: Sequence[int], cfg: Config = Config()) -> Config:
    """Lagged differences and targets only."""
    return cfg.with_features(
        horizons=tuple(latencies), enable_rolling=False, enable_ema=False, enable_acf=False,
        enable_spectral=False, enable_trend=False,
    )


def sweep_rows(
    sig: Signal, latencies: Sequence[int] = SWEEP_LATENCIES, n_train: int = 10_000, cfg: Config = Config(),
    inputs: bool = True,
) -> DataFrame:
    """Complete rows of all latencies; the first ``n_train`` of each train.

    Without ``inputs`` the lags of a row are not written, which the naive forecast does not read.
    """
    lags = replace(lag_config(latencies, cfg), scaling=None)
    wide = stage(wide_features(sig, lags), "sweep")
    return stacked_sets(
        sig, wide, lags, lambda df, keys, n: count_split(df, keys, n_train, n),
        None if inputs else [*sig.keys, "horizon", "seq", "split", "level", "level_lag", "y"],
    )[0]


def sweep_sets(rows: DataFrame, sig: Signal, latencies: Sequence[int], cfg: Config = Config()):
    lags = lag_config(latencies, cfg)
    return {h: one_set(rows, None, sig, h, lags) for h in latencies}


def naive_residuals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Residuals of "no change" at every latency, in one pass."""
    scored = scored_levels(rows.where("split = 'test'").withColumn("prediction", F.lit(0.0)))
    return _residuals(scored, keys, F.col("horizon"), "Naive")


def _residuals(scored, keys, latency, model):
    return scored.select(
        *keys, "seq", latency.alias("latency"), F.lit(model).alias("model"),
        "level", "predicted_level", "residual",
    )


def sweep_residuals(sets: dict[int, Dataset], models: dict[str, dict], seed: int = 42) -> DataFrame:
    """(keys, seq, latency, model, level, predicted_level, residual) of the test rows."""
    out = None
    for h, ds in sets.items():
        for name, params in models.items():
            fitted = fit(name, ds, params, seed)
            scored = scored_levels(fitted.score(ds.part("test")))
            part = _residuals(scored, ds.keys, F.lit(h), fitted.name)
            out = part if out is None else out.unionByName(part)
    return out


def variance_reduction(residuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Variance before and after, and the error, per model and latency."""
    r = F.col("residual")
    return residuals.groupBy(*keys, "model", "latency").agg(
        F.sqrt(F.avg(r * r)).alias("rmse"),
        F.var_pop(r).alias("precomp_variance"),
        F.var_pop("level").alias("input_variance"),
    )


def residual_matrix(residuals: DataFrame, keys: Sequence[str], latencies: Sequence[int], fill: float | None = FILL):
    """One row per sample, one column per latency; samples a latency lacks are filled."""
    wide = residuals.groupBy(*keys, "seq").pivot("latency", list(latencies)).agg(F.first("residual"))
    names = {str(h): f"latency_{h}" for h in latencies}
    wide = wide.withColumnsRenamed(names)
    return wide if fill is None else wide.na.fill(fill, subset=list(names.values()))


def prediction_table(residuals: DataFrame, keys: Sequence[str], latency: int, models: Sequence[str]):
    """The actual level next to one column per model, aligned by sample."""
    rows = residuals.where(F.col("latency") == latency)
    return (
        rows.groupBy(*keys, "seq", "level")
        .pivot("model", list(models))
        .agg(F.first("predicted_level"))
        .withColumnRenamed("level", "actual")
    )


def rmse_table(reduction: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One row per latency, one error column per model."""
    return reduction.groupBy(*keys, "latency").pivot("model", list(models)).agg(F.first("rmse"))
