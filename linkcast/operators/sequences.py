"""Lookback windows with a point or sequence target, and their normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcast.config import SplitConfig
from linkcast.operators.ordering import Signal, join_by_keys, spread


def default_lookback(horizon: int) -> int:
    return min(2 * horizon, 200)


def make_sequences(
    sig: Signal, lookback: int, horizon: int, sequence_output: bool | None = None, base="OptPow"
) -> DataFrame:
    """Windows of ``lookback`` values starting at ``seq``.

    ``y`` is the value ``horizon`` rows after the window, or with
    ``sequence_output`` the ``horizon`` rows after it (default above 100).
    """
    if sequence_output is None:
        sequence_output = horizon > 100
    df, f, own = spread(sig, 0, lookback + horizon - 1)
    x = F.col(base)
    inputs = f.over(F.collect_list(x), 0, lookback - 1)
    if sequence_output:
        y = f.over(F.collect_list(x), lookback, lookback + horizon - 1)
    else:
        y = f.lag(x, -(lookback + horizon - 1))
    # The last row a window needs must exist; counting rows also covers nulls.
    span = f.over(F.count(x), 0, lookback + horizon - 1)
    return (
        df.select(*sig.keys, "seq", inputs.alias("X"), y.alias("y"), span.alias("_n"), own.alias("_own"))
        .where(F.col("_own") & (F.col("_n") == lookback + horizon))
        .drop("_n", "_own")
    )


def sequence_split(
    sig: Signal, lookback: int, horizon: int, cfg: SplitConfig = SplitConfig(), purge: int = 0
) -> DataFrame:
    """Bounds of the window splits per series: (keys, n, val_from, test_from).

    ``purge`` leaves that many windows out on either side's later end, so that
    windows of two splits share no samples when it is lookback + horizon.
    """
    n = F.greatest(F.max("seq") + 1 - (lookback + horizon) + 1, F.lit(0))
    sizes = sig.df.groupBy(*sig.keys).agg(n.alias("n"))
    a = F.floor(F.col("n") * F.lit(cfg.train_ratio))
    return sizes.withColumn("val_from", a).withColumn(
        "test_from", a + F.floor(F.col("n") * F.lit(cfg.val_ratio))
    ).withColumn("purge", F.lit(purge))


def label_sequences(df: DataFrame, bounds: DataFrame, keys: Sequence[str], n_series: int):
    """Attach ``split`` to windows; purged windows are left out."""
    j = join_by_keys(df, bounds, keys, n_series)
    i, v, t, p = F.col("seq"), F.col("val_from"), F.col("test_from"), F.col("purge")
    split = F.when(i < v, "train").when(i < t, "val").otherwise("test")
    clear = ((i < v - p) | (i >= v)) & ((i < t - p) | (i >= t))
    return j.withColumn("split", split).where((p == 0) | clear).select(*df.columns, "split")


def sequence_stats(
    sig: Signal, bounds: DataFrame, lookback: int, method: str = "standard", base="OptPow"
) -> DataFrame:
    """One center and scale per series over all elements of all training windows.

    A sample lies in several windows; it is weighted by their number, so no
    window has to be built.
    """
    if method not in ("standard", "minmax"):
        raise ValueError(f"sequences are scaled by standard or minmax, not {method!r}")
    j = join_by_keys(sig.df, bounds, sig.keys, sig.n_series)
    i, last = F.col("seq"), F.col("val_from") - F.col("purge") - 1
    weight = F.least(i, last) - F.greatest(i - (lookback - 1), F.lit(0)) + 1
    w = j.withColumn("_w", weight.cast("double")).where(F.col("_w") > 0)
    x = F.col(base)
    if method == "minmax":
        stats = w.groupBy(*sig.keys).agg(
            F.min(x).alias("center"), (F.max(x) - F.min(x)).alias("scale")
        )
    else:
        # Shift by the plain mean first: the weighted squares then stay small.
        plain = sig.df.groupBy(*sig.keys).agg(F.avg(x).alias("_m"))
        d = x - F.col("_m")
        n = F.sum("_w")
        mean = F.sum(F.col("_w") * d) / n
        var = F.greatest(F.sum(F.col("_w") * d * d) / n - mean * mean, F.lit(0.0))
        stats = join_by_keys(w, plain, sig.keys, sig.n_series).groupBy(*sig.keys).agg(
            (mean + F.max("_m")).alias("center"), F.sqrt(var).alias("scale")
        )
    scale = F.col("scale")
    return stats.withColumn("scale", F.when(scale < 1e-8, 1.0).otherwise(scale))


def normalize_sequences(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], n_series: int, cols: Sequence[str] = ("X",)
):
    """The arrays of ``cols`` by their series' center and scale."""
    j = join_by_keys(df, stats, keys, n_series)
    scaled = {c: F.transform(c, lambda v: (v - F.col("center")) / F.col("scale")) for c in cols}
    return j.withColumns(scaled).select(df.columns)


def denormalize(df: DataFrame, stats: DataFrame, keys: Sequence[str], n_series: int, col: str):
    """Back to signal units, for a number or an array column."""
    j = join_by_keys(df, stats, keys, n_series)
    back = lambda v: v * F.col("scale") + F.col("center")
    is_array = df.schema[col].dataType.typeName() == "array"
    value = F.transform(col, back) if is_array else back(F.col(col))
    return j.withColumn(col, value).select(df.columns)
