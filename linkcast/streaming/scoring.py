"""Scoring a live stream with a saved model, each batch written once however often it runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from linkcast.sources.sinks import load_model

Write = Callable[[DataFrame, int], None]


def batch_folder(folder: str, change: Callable[[DataFrame], DataFrame] | None = None) -> Write:
    """Writes a batch to the folder of its id, over what an earlier try of it may have left."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = change(batch) if change else batch
        out.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that ``batch_folder`` wrote."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").drop("batch")


def to_batches(stream: DataFrame, write: Write) -> DataStreamWriter:
    return stream.writeStream.outputMode("append").foreachBatch(write)


def scorer(path: str, features: Sequence[str], level: str, keep: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """``keep``, the level now, the predicted change and level; rows that lack a feature cannot be scored.

    The model is read from its folder when the first batch comes, so that a restarted driver
    needs nothing but the path.
    """
    loaded: list[PipelineModel] = []

    def score(batch: DataFrame) -> DataFrame:
        if not loaded:
            loaded.append(load_model(path))
        rows = batch.na.drop(subset=[level, *features])
        return loaded[0].transform(rows).select(
            *keep, F.col(level).alias("level_now"), "prediction", (F.col(level) + F.col("prediction")).alias("predicted_level")
        )

    return score
