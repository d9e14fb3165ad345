"""Time-ordered splits and scaling fitted on the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkcast.config import SplitConfig
from linkcast.operators.ordering import join_by_keys
from linkcast.operators.quantiles import quantiles

CELL_ROWS = 65_536


def split_points(
    df: DataFrame,
    keys: Sequence[str],
    first: Column,
    second: Column,
    n_series: int,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Positions of the rows with the given ranks among the rows of ``df``.

    ``first`` and ``second`` are ranks stated over a column ``_total`` (rows of
    the series). Rows may be missing anywhere, so ranks are counted: rows per
    cell of positions first. In a cell without gaps a rank is a position; only
    the rows of cells with gaps that hold a wanted rank are numbered.
    """
    keys = list(keys)
    cell = F.floor(F.col("seq") / cell_rows)
    pos = df.select(*keys, "seq").withColumn("_cell", cell)
    cells = pos.groupBy(*keys, "_cell").agg(
        F.count("*").alias("_n"), F.min("seq").alias("_lo"), F.max("seq").alias("_hi")
    )
    ordered = Window.partitionBy(*keys).orderBy("_cell")
    cells = cells.withColumn(
        "_before", F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    cells = cells.withColumn("_a", first - F.col("_before")).withColumn(
        "_b", second - F.col("_before")
    )
    holds = lambda c: (F.col(c) >= 0) & (F.col(c) < F.col("_n"))
    dense = F.col("_hi") - F.col("_lo") + 1 == F.col("_n")
    gappy = cells.where((holds("_a") | holds("_b")) & ~dense).select(*keys, "_cell", "_a", "_b")
    near = join_by_keys(pos, gappy, [*keys, "_cell"], 2 * n_series)
    rank = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("seq")) - 1
    numbered = near.withColumn("_r", rank).select(
        *keys,
        F.when(F.col("_r") == F.col("_a"), F.col("seq")).alias("_val_from"),
        F.when(F.col("_r") == F.col("_b"), F.col("seq")).alias("_test_from"),
    )
    # Every series has a row here, so one too short for any cut is kept too.
    direct = cells.select(
        *keys,
        F.when(dense & holds("_a"), F.col("_lo") + F.col("_a")).alias("_val_from"),
        F.when(dense & holds("_b"), F.col("_lo") + F.col("_b")).alias("_test_from"),
    )
    both = direct.unionByName(numbered)
    return both.groupBy(*keys).agg(
        F.max("_val_from").alias("_val_from"), F.max("_test_from").alias("_test_from")
    )


def with_split(df: DataFrame, keys: Sequence[str], points: DataFrame, n_series: int) -> DataFrame:
    """Label rows train / val / test by the points of their series."""
    val, test = F.col("_val_from"), F.col("_test_from")
    label = (
        F.when(val.isNull() | (F.col("seq") < val), "train")
        .when(test.isNull() | (F.col("seq") < test), "val")
        .otherwise("test")
    )
    joined = join_by_keys(df, points, keys, n_series)
    return joined.withColumn("split", label).drop("_val_from", "_test_from")


def ratio_points(
    df: DataFrame, keys: Sequence[str], cfg: SplitConfig, n_series: int, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Where the validation and the test rows of every series begin."""
    n = F.col("_total")
    a = F.floor(n * F.lit(cfg.train_ratio))
    b = a + F.floor(n * F.lit(cfg.val_ratio))
    if cfg.min_train_samples > 0:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_total")).agg(F.min(a)).first()
        smallest = sizes[0] if sizes[0] is not None else 0
        if smallest < cfg.min_train_samples:
            raise ValueError(
                f"the shortest series has {smallest} training rows, min_train_samples asks for "
                f"{cfg.min_train_samples}"
            )
    return split_points(df, keys, a, b, n_series, cell_rows)


def ratio_split(
    df: DataFrame, keys: Sequence[str], cfg: SplitConfig, n_series: int, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Label rows train / val / test by their order within each series."""
    return with_split(df, keys, ratio_points(df, keys, cfg, n_series, cell_rows), n_series)


def count_split(
    df: DataFrame, keys: Sequence[str], n_train: int, n_series: int, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """The first ``n_train`` rows train, all later rows test."""
    at = F.lit(n_train)
    return with_split(df, keys, split_points(df, keys, at, at, n_series, cell_rows), n_series)


def fit_scaler(df: DataFrame, keys: Sequence[str], cols: Sequence[str], method: str = "standard"):
    """(keys, feature, center, scale) from the training rows; constants scale by 1."""
    keys, train = list(keys), df.where(F.col("split") == "train")
    if method == "standard":
        pair = lambda c: (F.avg(c), F.stddev_pop(c))
    elif method == "minmax":
        pair = lambda c: (F.min(c), F.max(c) - F.min(c))
    elif method == "robust":
        qs = quantiles(train, keys, cols, (0.25, 0.5, 0.75))
        return qs.select(
            *keys,
            F.col("name").alias("feature"),
            F.col("q")[1].alias("center"),
            _unit(F.col("q")[2] - F.col("q")[0]).alias("scale"),
        )
    else:
        raise ValueError(f"scaling is standard, minmax or robust, not {method!r}")
    aggs = []
    for i, c in enumerate(cols):
        center, scale = pair(c)
        entry = F.struct(
            F.lit(c).alias("feature"), center.alias("center"), _unit(scale).alias("scale")
        )
        aggs.append(entry.alias(f"_e{i}"))
    wide = train.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.inline(F.array(*[F.col(f"_e{i}") for i in range(len(cols))])))


def _unit(scale: Column) -> Column:
    return F.when(scale == 0, 1.0).otherwise(scale)


def apply_scaler(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], scaler: DataFrame, n_series: int
) -> DataFrame:
    """(x - center) / scale for every column of ``cols``."""
    keys = list(keys)
    wide = scaler.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("center", "scale")))).alias("_m")
    )
    flat = wide.select(
        *keys,
        *[F.col("_m")[c]["center"].alias(f"_c{i}") for i, c in enumerate(cols)],
        *[F.col("_m")[c]["scale"].alias(f"_s{i}") for i, c in enumerate(cols)],
    )
    joined = join_by_keys(df, flat, keys, n_series)
    scaled = {c: (F.col(c) - F.col(f"_c{i}")) / F.col(f"_s{i}") for i, c in enumerate(cols)}
    return joined.withColumns(scaled).select(df.columns)
