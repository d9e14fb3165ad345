"""Shards of nearly equal bytes by longest-processing-time scheduling.

Equal texts form a group and stay in one shard. Groups sorted by size go to the least
loaded shard through a heap. So that the heap stays small at any size, only groups that
hold more than ``1 / (shards * grain)`` of all bytes (at most ``shards * grain`` of
them) enter it by themselves; the others enter in ``shards * grain`` bundles picked by
the hash of the text. Both tables are bounded by parameters, not by the input.

A null text counts as empty. Rows with a null id are placed like all others. Repeated
rows each get a slot of their own. An empty table gives an empty result. Only the id and
text columns are read, so that extra columns may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkcast.llm.common import documents, query
from linkcast.session import stage

ROWS_PER_CELL = 16_384


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard per key from (key, size) pairs: the largest first, each to the least loaded."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def assign_shards(
    docs: DataFrame, shards: int = 24, grain: int = 256, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); size is UTF-8 bytes plus 8."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),  # a collision only keeps two texts together
        ),
        "shard-rows",
    )
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = stage(groups, "shard-groups")
    total, n_rows = groups.agg(F.sum("bytes"), F.sum("n")).first()
    limit = (total or 0) // (shards * grain) + 1
    large = groups.where(F.col("bytes") >= limit)  # at most shards * grain rows
    bundle = F.pmod(F.col("text_hash"), F.lit(shards * grain))
    bundles = groups.where(F.col("bytes") < limit).groupBy(bundle.alias("bundle")).agg(F.sum("bytes"))
    sizes = [((0, h), b) for h, b in large.select("text_hash", "bytes").collect()]
    sizes += [((1, k), b) for k, b in bundles.collect()]
    placed = longest_first(sizes, shards)

    def lookup(kind: int, key: str) -> DataFrame:
        found = [(k, s) for (what, k), s in placed.items() if what == kind]
        return F.broadcast(spark.createDataFrame(found, f"{key} long, {key}_shard int"))

    cells = max(1, -(-(n_rows or 0) // (shards * ROWS_PER_CELL)))
    at = (
        rows.withColumn("bundle", bundle)
        .join(lookup(0, "text_hash"), "text_hash", "left")
        .join(lookup(1, "bundle"), "bundle", "left")
        .select(
            "doc_id", "size", "text_crc32",
            F.coalesce("text_hash_shard", "bundle_shard").alias("shard"),
            F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int").alias("cell"),
        )
    )
    counts = at.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return at.join(starts, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.row_number().over(inside) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in 24 shards of nearly equal bytes; equal texts share a shard."""
    return assign_shards(documents(spark, sf))
