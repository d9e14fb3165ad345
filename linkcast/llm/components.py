"""Connected components of an edge table, by hooking to the smallest neighbour and jumping.

Every round halves the roots of a component at least, whatever its shape: vertices hook to
their smallest neighbour, parents of parents are taken until they stay, and the edges are
drawn anew between the roots. All tables are written between rounds; the driver sees counts. Few edges
are one partition, so that a round is a few tasks however many partitions a shuffle has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcast.llm.common import packed
from linkcast.session import stage

PER_PARTITION = 300_000  # edges or vertices


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, root) of every vertex of the edges (a, b), at most ``rows`` if given; the root is its smallest vertex."""
    rows = edges.count() if rows is None else rows
    keep = lambda df, name: packed(stage(packed(df, rows, PER_PARTITION), name), rows, PER_PARTITION)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    between = lambda e: e.select(low.alias("a"), high.alias("b")).where("a < b").distinct()
    left = keep(between(packed(edges, rows, PER_PARTITION)), "edges")
    labels = None
    while labels is None or left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = keep(
            both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("parent")), "parents"
        )
        while True:
            above = parents.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
            jumped = keep(parents.join(above, "parent").select(
                "id", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")
            ), "parents")
            parents = jumped.select("id", "parent")
            if not jumped.where("moved").limit(1).count():
                break
        if labels is None:
            labels = parents.select("id", F.col("parent").alias("root"))
        else:
            new = parents.select(F.col("id").alias("root"), "parent")
            labels = keep(labels.join(new, "root", "left").select(
                "id", F.coalesce("parent", "root").alias("root")), "labels")
        of = lambda c: parents.select(F.col("id").alias(c), F.col("parent").alias(f"root_{c}"))
        roots = left.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        left = keep(between(roots), "edges")
    return labels
