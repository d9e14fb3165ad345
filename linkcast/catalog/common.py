"""Shared pieces of the registered queries: the registry, input signals and SQL parts.

Floating-point results are rounded on both sides, since sums taken in another
order differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcast.config import Config, SignalConfig, SplitConfig
from linkcast.functions.scalar import r_squared, rmse
from linkcast.operators.ordering import Signal, index_series
from linkcast.operators.splits import ratio_split
from linkcast.operators.windows import Rolling, Targets, add_features
from linkcast.session import stage
from linkcast.sources.signals import load_signal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CFG = Config(
    base="x",
    signal=SignalConfig(max_samples=None, nonpositive="drop"),
    split=SplitConfig(min_train_samples=0),
)


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column; + 0.0 turns a negative zero into zero."""
    return df.select(
        *[
            (F.round(c, special.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_type").alias("series"), "ts", "event_id", "user_id", "value"
    )


def db_signal(spark: SparkSession, sf: str, cfg: Config = CFG, **index) -> Signal:
    """Decibel signal per event type, centred; samples without power are dropped."""
    return load_signal(events(spark, sf), "value", ["ts", "event_id"], ["series"], cfg, **index)


def uncentred_signal(spark: SparkSession, sf: str, **index) -> Signal:
    return db_signal(spark, sf, replace(CFG, signal=replace(CFG.signal, center="none")), **index)


def raw_signal(spark: SparkSession, sf: str, **index) -> Signal:
    """Linear power per event type."""
    df = events(spark, sf).where("value > 0").withColumn("x", F.col("value"))
    return index_series(df, ["series"], ["ts", "event_id"], ["x"], **index)


def price_signal(spark: SparkSession, sf: str, **index) -> Signal:
    """Item prices per supplier in shipping order (many ties in time)."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_suppkey").alias("series"),
        "l_shipdate", "l_orderkey", "l_linenumber",
        F.col("l_extendedprice").alias("x"),
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    return index_series(df, ["series"], order, ["l_orderkey", "l_linenumber", "x"], **index)


# SQL counterparts of the signals above.
IDX = """idx AS (
  SELECT event_type AS series, ts, event_id, value, 10 * log10(value) AS db,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seq
  FROM events WHERE value > 0)"""
SIG = f"""{IDX},
sig AS (SELECT series, seq, db - avg(db) OVER (PARTITION BY series) AS x FROM idx)"""
RAW = f"""{IDX}, sig AS (SELECT series, seq, value AS x FROM idx)"""
PRICE = """sig AS (
  SELECT l_suppkey AS series, l_orderkey, l_linenumber, l_extendedprice AS x,
         row_number() OVER (PARTITION BY l_suppkey
                            ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS seq
  FROM lineitem)"""
W = "PARTITION BY series ORDER BY seq"


def back(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


# Closed-form forecasters: the report queries judge these on the event signals.
# (name, level known at the time of the forecast, number of samples it reads)
BASELINES = (
    ("Naive", "x", 0),
    ("Mean 5", "x_rolling_mean_5", 5),
    ("Mean 10", "x_rolling_mean_10", 10),
    ("Mean 20", "x_rolling_mean_20", 20),
    ("Mean 50", "x_rolling_mean_50", 50),
)
REPORT_HORIZONS = (5, 50, 100)


def baseline_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(series, horizon, seq, split, model_name, model_complexity, y, prediction)."""
    sig = db_signal(spark, sf)
    wide = add_features(
        sig, [Rolling((5, 10, 20, 50), ("mean",), 1, "x"), Targets(REPORT_HORIZONS, True, "x")], keep=["x"]
    )
    wide = stage(wide, "levels")
    levels = [c for _, c, _ in BASELINES]
    per_horizon = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.col(f"target_{h}").alias("y"))
            for h in REPORT_HORIZONS
        ]
    )
    rows = wide.select("series", "seq", *levels, F.inline(per_horizon)).where("y IS NOT NULL")
    split = ratio_split(rows, ["series", "horizon"], CFG.split, sig.n_series * len(REPORT_HORIZONS))
    models = F.array(
        *[
            F.struct(
                F.lit(name).alias("model_name"),
                F.lit(size).cast("long").alias("model_complexity"),
                (F.col(level) - F.col("x")).alias("prediction"),
            )
            for name, level, size in BASELINES
        ]
    )
    return split.select("series", "horizon", "seq", "split", "y", F.inline(models))


def baseline_results(spark: SparkSession, sf: str) -> DataFrame:
    """A results table. Times are modelled from work done, so that they can be checked:
    training costs a microsecond per training row and sample read, inference a
    microsecond plus a tenth per sample read."""
    rows = baseline_rows(spark, sf)
    e = F.col("y") - F.col("prediction")
    on = lambda s, c: F.when(F.col("split") == s, c)
    test_e, test_y = on("test", e), on("test", F.col("y"))
    results = rows.groupBy("model_name", "horizon", "model_complexity").agg(
        rmse(on("train", e)).alias("train_rmse"),
        rmse(on("val", e)).alias("val_rmse"),
        rmse(test_e).alias("test_rmse"),
        F.avg(F.abs(test_e)).alias("test_mae"),
        r_squared(test_y, test_e).alias("test_r2"),
        F.var_pop(test_e).alias("residual_variance"),
        F.var_pop(on("test", F.col("prediction"))).alias("pred_variance"),
        (F.count(on("train", e)) * F.col("model_complexity") / F.lit(1e6)).alias("training_time"),
        ((F.col("model_complexity") + 10) / F.lit(1e4)).alias("inference_time_per_sample_ms"),
        F.count(on("train", e)).alias("n_train_samples"),
        F.count(test_e).alias("n_test_samples"),
    )
    return stage(results, "results")


_LEVELS = ",\n         ".join(f"avg(x) OVER {back(n)} AS m{n}" for n in (5, 10, 20, 50))
BASELINE_ROWS = f"""{SIG},
feat AS (SELECT series, seq, x, {_LEVELS} FROM sig),
tgt AS (
  SELECT f.*, h.horizon, lead(x, h.horizon) OVER (PARTITION BY series, h.horizon ORDER BY seq) - x AS y
  FROM feat f, (VALUES (5), (50), (100)) h(horizon)),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY series, horizon ORDER BY seq) - 1 AS i,
         count(*) OVER (PARTITION BY series, horizon) AS n
  FROM tgt WHERE y IS NOT NULL),
sp AS (
  SELECT *, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train'
                 WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val'
                 ELSE 'test' END AS split FROM kept),
scored AS (
  SELECT series, horizon, seq, split, y, 'Naive' AS model_name, 0::BIGINT AS model_complexity, 0.0::DOUBLE AS prediction FROM sp
  UNION ALL SELECT series, horizon, seq, split, y, 'Mean 5', 5, m5 - x FROM sp
  UNION ALL SELECT series, horizon, seq, split, y, 'Mean 10', 10, m10 - x FROM sp
  UNION ALL SELECT series, horizon, seq, split, y, 'Mean 20', 20, m20 - x FROM sp
  UNION ALL SELECT series, horizon, seq, split, y, 'Mean 50', 50, m50 - x FROM sp)"""
RESULTS = f"""{BASELINE_ROWS},
err AS (SELECT *, y - prediction AS e FROM scored),
res AS (
  SELECT model_name, horizon, model_complexity,
         sqrt(avg(e * e) FILTER (split = 'train')) AS train_rmse,
         sqrt(avg(e * e) FILTER (split = 'val')) AS val_rmse,
         sqrt(avg(e * e) FILTER (split = 'test')) AS test_rmse,
         avg(abs(e)) FILTER (split = 'test') AS test_mae,
         1 - sum(e * e) FILTER (split = 'test')
             / (var_pop(y) FILTER (split = 'test') * count(*) FILTER (split = 'test')) AS test_r2,
         var_pop(e) FILTER (split = 'test') AS residual_variance,
         var_pop(prediction) FILTER (split = 'test') AS pred_variance,
         count(*) FILTER (split = 'train') * model_complexity / 1e6 AS training_time,
         (model_complexity + 10) / 1e4 AS inference_time_per_sample_ms,
         count(*) FILTER (split = 'train') AS n_train_samples,
         count(*) FILTER (split = 'test') AS n_test_samples
  FROM err GROUP BY model_name, horizon, model_complexity)"""
