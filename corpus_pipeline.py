"""From raw documents to packed training sequences: the stages, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a table that is written before the next
one reads it. All but the last return the columns of ``documents``:

* ``language`` lets documents go whose language is rejected (``und`` or too far from every
  centroid);
* ``line_dedup`` takes lines away that an earlier document holds, and documents that lose
  all of their lines;
* ``near_dedup`` keeps one row of each group of near-duplicates, the smallest id; rows without
  an id are documents of their own, which come last;
* ``decontamination`` lets documents go that leak a benchmark item;
* ``packing`` gives the pieces of what is left in sequences of at most 2048 ids.

``ORACLE_SQL`` is None: trained centroids, tokens and the packing are beyond SQL; the tests
compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcast.llm import decontam
from linkcast.llm import language as lang
from linkcast.llm.lines import dedup_lines
from linkcast.llm.neardup import digest, near_rows, sized
from linkcast.llm.packing import cut_pieces, pack
from linkcast.llm.tokens import vocabulary
from linkcast.session import stage


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the input does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    col = unused(docs, "found")
    found = lang.identify(docs, lang.train(docs), out_col=col)
    return found.where(f"NOT {col}.rejected").drop(col)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = dedup_lines(docs).where("n_dropped < n_lines")
    return left.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = near_rows(docs).where("n_shingles > 0").groupBy("doc_id", "digest")
    found = stage(rows.agg(F.bool_and("first").alias("first"), F.count("*").alias("n")), "copies")
    changed = stage(found.where("NOT first OR n > 1"), "changed")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = docs.select(row, F.col("doc_id").cast("long").alias("a_id"), digest("text").alias("a_digest"))
    same = F.col("a_id").eqNullSafe(F.col("doc_id")) & (F.col("a_digest") == F.col("digest"))
    left = whole.join(sized(changed.select("doc_id", "digest")), same, "left_anti").select("row.*")
    repeated = changed.where("first").select("doc_id", "digest")
    if not repeated.limit(1).count():
        return left
    # The least of equal rows, so that a task that runs again chooses the same.
    one = whole.join(sized(repeated), same).groupBy("doc_id", "digest").agg(F.min("row").alias("row"))
    return left.unionByName(one.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    indexes = decontam.build(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    col = unused(docs, "found")
    return decontam.find_leaks(docs, indexes, out_col=col).where(F.size(col) == 0).drop(col)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(docs, vocabulary("word_bpe_49k.json"), False, 0))


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
