"""Starting streams over files, draining them, and feeding them in parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

# Fixed value: the state store that keyed state with lists and timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the start of a stream, which keeps them; then as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def file_stream(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, new files as they come."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def drain(writer: DataStreamWriter, checkpoint: str) -> list[dict]:
    """Process everything that is there, from where the checkpoint stands; the progress of each batch."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        return [p if isinstance(p, dict) else p.jsonValue for p in query.recentProgress]
    finally:
        query.stop()


def to_parquet(stream: DataFrame, folder: str) -> DataStreamWriter:
    """Append rows to a folder; Spark's file log there gives every row once."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", folder)


def feed(parts: list[DataFrame], folder: str, run: Callable[[], list[dict]]) -> list[dict]:
    """Add the parts to a folder one after the other, with a run from the checkpoint after each."""
    progress = []
    for part in parts:
        part.write.mode("append").parquet(folder)
        progress += run()
    return progress
