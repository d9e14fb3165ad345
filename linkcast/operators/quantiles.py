"""Exact percentiles with linear interpolation, per group, at any group size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcast.functions.scalar import is_missing
from linkcast.operators.ordering import SHORT_SERIES, index_series, join_by_keys, series_sizes


def long_form(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, name, value) rows of the columns' values that are present."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols]
    )
    return df.select(*keys, F.inline(pairs)).where(~is_missing("value"))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    probs: Sequence[float],
    short_group: int = SHORT_SERIES,
    approximate: bool = False,
) -> DataFrame:
    """(keys, name, q array) with one entry per probability.

    ``percentile`` keeps a group's distinct values in one task, so it is used
    only while the largest counted group is small; otherwise the values are
    ranked by a range sort and the neighbouring ranks are picked. Either way a
    group without values has one row, whose ``q`` is null.
    """
    keys, ranks = list(keys), [float(p) for p in probs]
    literal = F.array(*[F.lit(p) for p in ranks])
    if approximate or series_sizes(df, keys)[1] <= short_group:
        fn = F.approx_percentile if approximate else F.percentile
        # NaN would sort above every number, so it counts as missing.
        aggs = [fn(F.when(~is_missing(c), F.col(c).cast("double")), literal) for c in cols]
        pairs = [
            F.struct(F.lit(c).alias("name"), F.col(f"_q{i}").alias("q"))
            for i, c in enumerate(cols)
        ]
        wide = df.groupBy(*keys).agg(*[a.alias(f"_q{i}") for i, a in enumerate(aggs)])
        return wide.select(*keys, F.inline(F.array(*pairs)))
    group = [*keys, "name"]
    picked = _pick(long_form(df, keys, cols), group, ranks)
    names = F.explode(F.array(*[F.lit(c) for c in cols])).alias("name")
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n")) if keys else df.agg(F.count("*").alias("_n"))
    return join_by_keys(groups.select(*keys, names), picked, group, None, "left")


def _pick(long: DataFrame, group: list[str], probs: list[float]) -> DataFrame:
    long = long.withColumn("_v", F.col("value"))
    ranked = index_series(long, group, ["value"], ["_v"], short_series=0)
    sizes = ranked.df.groupBy(*group).agg(F.count("*").alias("_n"))
    rows = join_by_keys(ranked.df, sizes, group, ranked.n_series)
    parts = []
    for p in probs:
        h = (F.col("_n") - 1) * F.lit(p)
        weight = F.when(F.col("seq") == F.floor(h), 1 - (h - F.floor(h))).when(
            F.col("seq") == F.floor(h) + 1, h - F.floor(h)
        )
        parts.append(F.sum(weight * F.col("_v")))
    return rows.groupBy(*group).agg(F.array(*parts).alias("q"))
