"""Comparison tables, rankings, trends and recommendations over a results table.

A results table has one row per model and horizon. Differences and levels are
not comparable, so every ranking is kept apart by ``target_kind`` where the
table has that column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkcast.config import BASELINE_RMSE
from linkcast.functions.scalar import improvement_pct, increase_pct, samples_to_ms
from linkcast.plans.forecast import failed_row, fit, log, results_row


def append_results(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all models; columns some lack are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def evaluation_matrix(sets: Mapping, models: Mapping[str, Mapping], seed: int = 42, parallel: int = 4) -> DataFrame:
    """Every model on every horizon, some at a time; a pair that fails is a row with the reason."""

    def judge(pair):
        ds, name, params = pair
        try:
            return results_row(fit(name, ds, params, seed), ds)
        except Exception as exc:
            log.warning("%s at horizon %s failed: %s", name, ds.horizon, exc)
            return failed_row(name, ds, str(exc)[:300])

    pairs = [(ds, name, params) for ds in sets.values() for name, params in models.items()]
    if not pairs:
        raise ValueError("no model or no horizon to evaluate")
    with ThreadPoolExecutor(parallel) as pool:
        return append_results(list(pool.map(judge, pairs)))


def _group(df: DataFrame) -> list[str]:
    return ["target_kind"] if "target_kind" in df.columns else []


def _baseline(df: DataFrame, baseline) -> DataFrame:
    """Add ``_base``: one number, a number per horizon, or a model of the table."""
    if isinstance(baseline, str):
        own = df.where(F.col("model_name") == baseline)
        table = own.select(*_group(df), "horizon", F.col("test_rmse").alias("_base"))
        return df.join(table, [*_group(df), "horizon"], "left")
    if isinstance(baseline, Mapping):
        pairs = [F.lit(x) for kv in baseline.items() for x in kv]
        return df.withColumn("_base", F.create_map(*pairs)[F.col("horizon")])
    return df.withColumn("_base", F.lit(baseline).cast("double"))


def compare_models(df: DataFrame, horizons=None, baseline=BASELINE_RMSE) -> DataFrame:
    """Errors and times with gain over the baseline and overfitting, in percent."""
    if horizons is not None:
        df = df.where(F.col("horizon").isin(list(horizons)))
    with_base = _baseline(df, baseline)
    return with_base.select(
        *_group(df),
        "model_name", "horizon", "test_rmse", "test_mae", "pred_variance", "training_time",
        "inference_time_per_sample_ms",
        improvement_pct("_base", "test_rmse").alias("vs_baseline_pct"),
        increase_pct("train_rmse", "test_rmse").alias("overfitting_pct"),
    ).orderBy(*_group(df), "horizon", "test_rmse", "model_name")


def _best(df: DataFrame, by: Sequence[str], metric: str, largest: bool = False) -> DataFrame:
    """The row with the best metric per group; ties go to the first name."""
    tie = F.struct(-F.col(metric) if largest else F.col(metric), "model_name", "horizon")
    row = F.min_by(F.struct(*df.columns), tie).alias("_r")
    return df.where(F.col(metric).isNotNull()).groupBy(*by).agg(row).select("_r.*")


def best_overall(df: DataFrame, metric: str = "test_rmse", baseline=BASELINE_RMSE) -> DataFrame:
    best = _baseline(_best(df, _group(df), metric), baseline)
    return best.withColumn("horizon_ms", samples_to_ms("horizon")).withColumn(
        "vs_baseline_pct", improvement_pct("_base", "test_rmse")
    ).drop("_base")


def best_per_horizon(df: DataFrame, metric: str = "test_rmse", baseline=BASELINE_RMSE) -> DataFrame:
    best = _baseline(_best(df, [*_group(df), "horizon"], metric), baseline)
    return best.withColumn("horizon_ms", samples_to_ms("horizon")).withColumn(
        "vs_baseline_pct", improvement_pct("_base", "test_rmse")
    ).drop("_base")


def model_means(df: DataFrame) -> DataFrame:
    names = {
        "test_rmse": "avg_rmse", "test_mae": "avg_mae", "test_r2": "avg_r2",
        "training_time": "avg_training_time", "inference_time_per_sample_ms": "avg_inference_time_ms",
    }
    return df.groupBy(*_group(df), "model_name").agg(*[F.avg(c).alias(n) for c, n in names.items()])


def spread_by_model(df: DataFrame, metric: str = "test_rmse") -> DataFrame:
    return df.groupBy(*_group(df), "model_name").agg(
        F.avg(metric).alias("mean"), F.min(metric).alias("min"), F.max(metric).alias("max")
    )


def stability(df: DataFrame) -> DataFrame:
    return df.groupBy(*_group(df), "model_name").agg(F.stddev_samp("test_rmse").alias("rmse_std"))


def rank_models(df: DataFrame, baseline: float = BASELINE_RMSE) -> DataFrame:
    w = Window.partitionBy(*_group(df)).orderBy("avg_rmse", "model_name")
    return model_means(df).withColumn("rank", F.row_number().over(w)).withColumn(
        "vs_baseline_pct", improvement_pct(F.lit(baseline), "avg_rmse")
    )


def horizon_trend(df: DataFrame) -> DataFrame:
    """Growth of the error from the shortest to the longest horizon, per model."""
    return df.groupBy(*_group(df), "model_name").agg(
        F.min_by("test_rmse", "horizon").alias("first_rmse"),
        F.max_by("test_rmse", "horizon").alias("last_rmse"),
    ).withColumn("rmse_change_pct", increase_pct("first_rmse", "last_rmse"))


def near_best(df: DataFrame, metric: str = "test_rmse", within: float = 1.1) -> DataFrame:
    """Rows whose metric is at most ``within`` times the best one."""
    limit = df.groupBy(*_group(df)).agg((F.min(metric) * within).alias("_limit"))
    return _attach(df, limit, _group(df)).where(F.col(metric) <= F.col("_limit")).select(df.columns)


def recommendations(df: DataFrame, within: float = 1.1) -> DataFrame:
    """(criterion, model, horizon, value): accuracy, trade-off, inference, stability."""
    group = _group(df)
    accurate = _best(df, group, "test_rmse")
    timed = df.groupBy(*group).agg((F.max("training_time") > 0).alias("_timed"))
    near = _attach(near_best(df, "test_rmse", within), timed, group).where("_timed")
    fast = _best(near.select(df.columns), group, "training_time")
    quick = _best(df, group, "inference_time_per_sample_ms")
    steady = stability(df).where(F.col("rmse_std").isNotNull())
    steady = steady.groupBy(*group).agg(
        F.min_by(F.struct("model_name", "rmse_std"), F.struct("rmse_std", "model_name")).alias("_r")
    ).select(*group, "_r.model_name", F.lit(None).cast("int").alias("horizon"), "_r.rmse_std")

    def line(name, frame, value):
        return frame.select(
            *group, F.lit(name).alias("criterion"), F.col("model_name").alias("model"),
            "horizon", F.col(value).alias("value"),
        )

    return (
        line("accuracy", accurate, "test_rmse")
        .unionByName(line("speed_accuracy", fast, "training_time"))
        .unionByName(line("inference", quick, "inference_time_per_sample_ms"))
        .unionByName(line("stability", steady, "rmse_std"))
    )


def _attach(df, one_row, group):
    """Add a one-row-per-group table; without groups it has exactly one row."""
    if group:
        return df.join(F.broadcast(one_row), group)
    key = F.lit(1).alias("_k")
    return df.select("*", key).join(F.broadcast(one_row.select("*", key)), "_k").drop("_k")


def overall(df: DataFrame) -> DataFrame:
    return df.groupBy(*_group(df)).agg(
        F.count_distinct("model_name").alias("n_models"),
        F.array_sort(F.collect_set("horizon")).alias("horizons"),
        F.count("*").alias("n_evaluations"),
    )


def metric_by_horizon(df: DataFrame, models: Sequence[str], metric: str = "test_rmse") -> DataFrame:
    """One row per horizon, one column per model."""
    return df.groupBy(*_group(df), "horizon").pivot("model_name", list(models)).agg(F.first(metric))


def chart_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The data behind the usual charts of a results table."""
    g = _group(df)
    line = [*g, "model_name", "horizon", samples_to_ms("horizon").alias("horizon_ms")]
    return {
        "errors": df.select(*line, "test_rmse", "test_r2", "residual_variance"),
        "time_vs_error": df.where(F.col("training_time") > 0).select(
            *line, "training_time", "test_rmse"
        ),
        "inference": df.groupBy(*g, "model_name").agg(
            F.avg("inference_time_per_sample_ms").alias("avg_inference_time_ms")
        ),
        "complexity": df.groupBy(*g, "model_name").agg(
            F.avg("model_complexity").alias("avg_complexity")
        ),
    }


def top_features(importances: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` weightiest features per model and horizon; coefficients keep their sign."""
    w = Window.partitionBy("model", "horizon").orderBy(F.desc(F.abs("importance")), "feature")
    return importances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
