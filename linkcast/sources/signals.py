"""Reading signals: conditions, ordering, decibel conversion, centring, metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcast.config import Config
from linkcast.functions.scalar import power_to_db
from linkcast.operators.ordering import Signal, index_series, join_by_keys


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options):
    """Scan Parquet, ORC, CSV or JSON; text formats need an explicit schema."""
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"give a schema for {fmt} input")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_conditions(
    spark: SparkSession,
    catalogue: Mapping[str, str],
    conditions: Sequence[str] | None = None,
    fmt: str = "parquet",
    schema=None,
    **options,
) -> DataFrame:
    """Union of the chosen conditions' tables with a ``series`` column."""
    chosen = list(catalogue) if conditions is None else list(conditions)
    unknown = [c for c in chosen if c not in catalogue]
    if unknown or not chosen:
        raise ValueError(f"unknown condition {unknown}; known: {sorted(catalogue)}")
    out = None
    for name in chosen:
        part = read_table(spark, catalogue[name], fmt, schema, **options)
        part = part.withColumn("series", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def load_signal(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    keys: Sequence[str] = ("series",),
    cfg: Config = Config(),
    to_db: bool = True,
    **index,
) -> Signal:
    """Index a power table and turn it into a centred decibel signal.

    ``max_samples`` keeps the first rows in order, before the mean is taken. NaN becomes
    null, so that averages skip it. Rows with a null key are one more series.
    """
    s, base = cfg.signal, cfg.base
    if to_db and s.nonpositive == "drop":
        df = df.where(F.col(value) > 0)
    x = power_to_db(value, s.nonpositive) if to_db else F.col(value).cast("double")
    df = df.withColumn(base, F.when(~F.isnan(x), x))
    sig = index_series(df, keys, order, [base], **index)
    return center(limit(sig, s.max_samples), cfg)


def limit(sig: Signal, max_samples: int | None) -> Signal:
    """The first rows of every series."""
    if max_samples is None or sig.longest <= max_samples:
        return sig
    return sig.with_df(sig.df.where(F.col("seq") < max_samples))


def center(sig: Signal, cfg: Config = Config()) -> Signal:
    """Subtract each series' mean, over all rows or over its training rows."""
    mode, base = cfg.signal.center, cfg.base
    if mode == "none":
        return sig
    rows = sig.df
    if mode == "train":
        sizes = rows.groupBy(*sig.keys).agg(F.count("*").alias("_n"))
        rows = join_by_keys(rows, sizes, sig.keys, sig.n_series)
        rows = rows.where(F.col("seq") < F.floor(F.col("_n") * cfg.split.train_ratio))
    elif mode != "all":
        raise ValueError(f"unknown centring: {mode}")
    means = rows.groupBy(*sig.keys).agg(F.avg(base).alias("_mean"))
    df = sig.attach(means).withColumn(base, F.col(base) - F.col("_mean")).drop("_mean")
    return sig.with_df(df.select(sig.df.columns))


def metadata(sig: Signal, cfg: Config = Config()) -> DataFrame:
    """Size, duration and decibel range per series of an uncentred signal."""
    x = F.col(cfg.base)
    return sig.df.groupBy(*sig.keys).agg(
        F.count("*").alias("n_samples"),
        F.lit(cfg.signal.sampling_rate).alias("sampling_rate"),
        (F.count("*") / F.lit(float(cfg.signal.sampling_rate))).alias("duration_sec"),
        F.avg(x).alias("mean_db"),
        F.stddev_pop(x).alias("std_db"),
        (F.min(x) - F.avg(x)).alias("min_db"),
        (F.max(x) - F.avg(x)).alias("max_db"),
    )
