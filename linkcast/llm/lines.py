"""Removal of lines that other documents hold, against levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z lower-cased. A key
of at least ``min_chars`` code points that several documents hold keeps its lines only in
the document with the smallest id. Other lines stay.

The known keys live in *runs*: tables of (key hash, id of the owner), bucketed and sorted
by hash. A batch of documents is merge-joined with the runs: keys that no run knows (the
anti-join) become a new run on level 0, the known ones are logged with their owner.
``fanout`` runs of a level are merged into one of the next, so that a batch meets a number
of runs that grows with the logarithm of the batches. All runs are bucketed alike, hence
old keys are not shuffled when a batch meets them. Batches must come in ascending order of
ids; ``dedup_lines`` cuts its input that way.

Null or empty texts are one empty line. Rows with a null id count as one document that
comes after all others. Repeated rows of one id count as one document and each keep the
same lines. A document that loses all its lines keeps an empty text. Other columns are
carried as they are, whatever their names. Keys are compared by their 128-bit MD5.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcast.llm.common import LAST_ID, SPACES, ascii_lower, documents, let, partitions, query
from linkcast.session import stage, stage_root

MIN_CHARS = 10


class LineRuns:
    """Known line keys in levelled runs; ``shared`` lists those that several documents hold."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or partitions(spark)
        self.levels: list[list[str]] = []
        self.batches: list[str] = []

    def add(self, keys: DataFrame) -> None:
        """Take a batch's (h, owner, last): one row per key, with its smallest and largest id."""
        firsts = []
        for level in self.levels:
            for name in level:
                first = f"first_{len(firsts)}"
                run = self.spark.table(name).where("NOT seen").select("h", F.col("owner").alias(first))
                keys = keys.join(run, "h", "left")
                firsts.append(F.col(first))
        found = F.coalesce(*firsts) if firsts else F.lit(None).cast("long")
        met = keys.select(
            "h",
            F.coalesce(found, "owner").alias("owner"),
            (found.isNotNull() | (F.col("last") > F.col("owner"))).alias("shared"),
            found.isNotNull().alias("seen"),
        )
        name = self._write(met)
        self.batches.append(name)
        self._place(name, 0)

    def _place(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            self.compact(level)

    def compact(self, level: int) -> None:
        """Merge the runs of a level, whose keys are disjoint, into one of the next."""
        parts, self.levels[level] = self.levels[level], []
        merged = self.spark.table(parts[0]).where("NOT seen")
        for name in parts[1:]:
            merged = merged.unionByName(self.spark.table(name).where("NOT seen"))
        self._place(self._write(merged), level + 1)
        for name in set(parts) - set(self.batches):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            keys.repartition(self.buckets, "h")
            .write.partitionBy("seen")
            .bucketBy(self.buckets, "h")
            .sortBy("h")
            .option("path", f"{stage_root(self.spark)}/{name}")
            .saveAsTable(name)
        )
        return name

    def shared(self) -> DataFrame:
        """(h, owner) of the keys that more than one document holds."""
        logs = self.spark.table(self.batches[0])
        for name in self.batches[1:]:
            logs = logs.unionByName(self.spark.table(name))
        return logs.where("shared").groupBy("h").agg(F.min("owner").alias("owner"))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    batches: int = 4,
    fanout: int = 3,
) -> DataFrame:
    """(row, text, n_lines, n_dropped): the input row as a struct and the text that is left."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        text.alias("text"),
    )
    ids = base.select("id")
    cuts = ids.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 10_000)).first()[0]
    batch = sum(((F.col("id") > c).cast("int") for c in cuts or []), F.lit(0))
    lines = base.select(
        batch.alias("batch"), "id", F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    ).select("batch", "id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    lines = stage(
        lines.where(F.length("key") >= min_chars).select(
            "batch", "id", "text_hash", "pos", F.unhex(F.md5("key")).alias("h")
        ),
        "line-hashes",
    )
    runs = LineRuns(spark, fanout)
    for k in range(batches):
        keys = lines.where(F.col("batch") == k).groupBy("h")
        runs.add(keys.agg(F.min("id").alias("owner"), F.max("id").alias("last")))
    shared = stage(runs.shared(), "shared-lines")  # written, so that a frequent key's join can be split
    dropped = (
        lines.join(shared, "h")
        .where("id > owner")
        .groupBy("id", "text_hash")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    out = base.withColumn("text_hash", F.xxhash64("text")).join(dropped, ["id", "text_hash"], "left")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    left = let(
        F.split("text", "\n"),
        lambda all_lines: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("dropped")),
                lambda i: F.get(all_lines, i),
            ),
            "\n",
        ),
    )
    return out.select(
        "row",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(left).alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


# The key of a line in DuckDB; chr() keeps the white space readable.
SQL_KEY = """translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (SELECT *, {SQL_KEY} AS key FROM lines),
owned AS (
  SELECT *, min(doc_id) OVER (PARTITION BY key) AS owner FROM keyed)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (length(key) >= {MIN_CHARS} AND owner < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
              FILTER (NOT (length(key) >= {MIN_CHARS} AND owner < doc_id)), '')) AS kept_sha256
FROM owned GROUP BY doc_id
"""


@query("op1_line_dedup", OP1_SQL)
def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, dropped lines and the digest of what is left, per document."""
    return dedup_lines(documents(spark, sf)).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )
