"""Writing results, feature importance, metrics, predictions and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite"):
    """Results table as Parquet or as CSV with a header."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_importance(df: DataFrame, path: str, mode: str = "overwrite"):
    """One CSV folder per model and horizon."""
    df.write.mode(mode).partitionBy("model", "horizon").option("header", True).csv(path)


def metrics_documents(results: DataFrame) -> DataFrame:
    """One row per model, and kind of target if known, with its metrics nested by horizon."""
    number = [c for c, t in results.dtypes if t in ("double", "float")]
    test = [c for c in number if not c.startswith(("train", "val"))]
    train = [c for c in number if c.startswith("train")]
    entry = F.struct(
        F.struct(*test).alias("test_metrics"), F.struct(*train).alias("train_metrics")
    )
    kind = [c for c in ("target_kind",) if c in results.columns]
    return results.groupBy(*kind, "model_name").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("horizon").cast("string"), entry)))
        ).alias("horizons")
    )


def write_metrics(results: DataFrame, path: str, mode: str = "overwrite"):
    metrics_documents(results).write.mode(mode).json(path)


def save_model(model: PipelineModel, path: str):
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
