"""From a power table to scaled train / validation / test sets per horizon."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcast.config import Config
from linkcast.operators.ordering import Signal
from linkcast.operators.splits import apply_scaler, fit_scaler, ratio_points, ratio_split, with_split
from linkcast.operators.stats import validate
from linkcast.plans.features import (
    complete_rows, feature_names, long_form, shared_names, wide_features,
)
from linkcast.session import stage
from linkcast.sources.signals import center, load_signal, metadata


@dataclass
class Dataset:
    """Prepared data of one horizon."""

    df: DataFrame  # keys, seq, split, level, level_lag, features, y
    scaler: DataFrame | None
    features: list[str]
    horizon: int
    keys: tuple[str, ...]
    target_kind: str = "difference"

    def part(self, split: str) -> DataFrame:
        return self.df.where(F.col("split") == split)


@dataclass
class Prepared:
    signal: Signal
    metadata: DataFrame
    wide: DataFrame
    cfg: Config
    sets: dict[int, Dataset] = field(default_factory=dict)


def tap_names(cfg: Config, horizon: int) -> dict[str, str]:
    """Columns of the stacked table that carry another name in one horizon's set."""
    names = feature_names(cfg, horizon)
    shared = set(shared_names(cfg))
    return {f"tap{i}": n for i, n in enumerate(n for n in names if n not in shared)}


def stacked_sets(sig: Signal, wide: DataFrame, cfg: Config = Config(), split=None, columns=None):
    """All horizons' complete rows with their split, scaled in one pass.

    Returns the rows, written sorted by horizon and split so that a fit reads
    little more than its own, and the scaler table. ``split(rows, keys, n)`` replaces
    the ratio split; ``columns`` are all that is written, where not every column is needed.
    """
    keys = [*sig.keys, "horizon"]
    groups = sig.n_series * len(cfg.features.horizons)
    rows = _stacked(sig, wide, cfg)
    if split is None:
        rows = ratio_split(rows, keys, cfg.split, groups)
    else:
        rows = split(rows, keys, groups)
    scaler = None
    if cfg.scaling:
        names = _scaled_names(cfg)
        scaler = stage(fit_scaler(rows, keys, names, cfg.scaling), "scaler")
        rows = apply_scaler(rows, keys, names, scaler, groups)
    if columns:
        rows = rows.select(*columns)
    return stage(rows, "sets", ("horizon", "split")), scaler


def read_sets(sig: Signal, wide: DataFrame, cfg: Config = Config()) -> dict[int, Dataset]:
    """The set of every horizon, split and scaled while it is read from the wide table.

    Only the split points and the scaler are written: the rows of all horizons together
    would take the room of the wide table once for every horizon.
    """
    keys = [*sig.keys, "horizon"]
    groups = sig.n_series * len(cfg.features.horizons)
    stacked = _stacked(sig, wide, cfg)
    points = stage(ratio_points(stacked, keys, cfg.split, groups), "points")
    scaler, names = None, _scaled_names(cfg)
    if cfg.scaling:
        scaler = stage(fit_scaler(with_split(stacked, keys, points, groups), keys, names, cfg.scaling), "scaler")
    out = {}
    for h in cfg.features.horizons:
        one, here = cfg.with_features(horizons=(h,)), F.col("horizon") == h
        rows = with_split(_stacked(sig, wide, one), keys, points.where(here), sig.n_series)
        if scaler is not None:
            rows = apply_scaler(rows, keys, names, scaler.where(here), sig.n_series)
        out[h] = one_set(rows, scaler, sig, h, cfg)
    return out


def _stacked(sig: Signal, wide: DataFrame, cfg: Config) -> DataFrame:
    """The complete rows of all horizons."""
    return complete_rows(long_form(wide, sig.keys, cfg)).withColumnsRenamed({cfg.base: "level", "target": "y"})


def _scaled_names(cfg: Config) -> list[str]:
    return [*tap_names(cfg, cfg.features.horizons[0]), *shared_names(cfg)]


def one_set(rows: DataFrame, scaler, sig: Signal, horizon: int, cfg: Config) -> Dataset:
    """The set of one horizon out of the stacked rows."""
    taps, names = tap_names(cfg, horizon), feature_names(cfg, horizon)
    here = F.col("horizon") == horizon
    df = rows.where(here).withColumnsRenamed(taps).select(
        *sig.keys, "seq", "split", "level", "level_lag", *names, "y"
    )
    if scaler is not None:
        scaler = scaler.where(here).drop("horizon").replace(taps, subset=["feature"])
    return Dataset(df, scaler, names, horizon, sig.keys)


def prepare(
    df: DataFrame,
    value: str,
    order,
    keys=("series",),
    cfg: Config = Config(),
    check: bool = True,
    to_db: bool = True,
    **index,
) -> Prepared:
    """Load, validate, build features once, then split and scale every horizon.

    The wide feature table is written once, so that the split, the scaler and
    the scaled rows read it instead of computing windows again. The rows of a single
    horizon are written too; those of several are made from the wide table at each reading.
    """
    uncentred = replace(cfg, signal=replace(cfg.signal, center="none"))
    raw = load_signal(df, value, order, keys, uncentred, to_db, **index)
    sig = center(raw, cfg)
    if check:
        validate(sig.df, [cfg.base], "raw data", cfg.validation)
    wide = stage(wide_features(sig, cfg), "features")
    out = Prepared(sig, metadata(raw, cfg), wide, cfg)
    if len(cfg.features.horizons) > 1:
        out.sets = read_sets(sig, wide, cfg)
    else:
        rows, scaler = stacked_sets(sig, wide, cfg)
        out.sets = {h: one_set(rows, scaler, sig, h, cfg) for h in cfg.features.horizons}
    if check:
        for h, ds in out.sets.items():
            validate(ds.part("train"), [*ds.features, "y"], f"train set, horizon {h}", cfg.validation)
    return out
