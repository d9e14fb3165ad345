"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, components.

Two documents are linked when the Jaccard similarity of their distinct five-word shingles is
at least ``percent`` / 100. The steps:

1. Every text gives its shingle set as 64-bit hashes, a 128-bit hash of the set, the keys of
   40 bands of 4 MinHash samples, and an odd sketch: bit *i* is the parity of the samples
   that hash to *i*. Equal sets are one from here on. A pair at similarity 0.75 shares no
   band with probability 2.5e-7, at 0.8 with 6e-10.
2. In every bucket each member is a candidate with the bucket's smallest id, so that a bucket
   of any size gives as many candidates as members. The population count of the XOR of two
   odd sketches estimates their similarity within 0.035; pairs estimated at less than 0.55
   are let go, all others are confirmed on full sets. Their links give components.
3. Buckets with members in several components are looked at again, in groups of buckets that share
   members. Small groups are compared pair by pair. In a large one, such as a family of copies with
   many edits, a member is its difference D to the group's centre, the shingles that more than
   half of its members hold. Members with small differences are linked at once, each to the one
   with the least; all other links need common elements of D, of which there must be enough on
   both sides. Members that share one of their rarest common elements form smaller groups, and so
   on. This is exact: pairs inside a component are never formed, and no bucket or candidate is left out.

Words are split at ASCII white space after lower-casing A-Z. With fewer than five words the
whole sequence is the one shingle. Null texts and texts without words have no shingles and
are linked with nothing. Sets are numbered in the order of their smallest id, and all links
are between these numbers. A row without an id is a document of its own that comes after all
ids and comes back as null. Repeated rows give repeated rows with one decision; different
texts under one id are looked at separately. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkcast.llm.common import LAST_ID, documents, packed, query, tidy
from linkcast.llm.components import components
from linkcast.llm.shingles import MinHasher, set_hash, shingles
from linkcast.session import stage

BANDS, ROWS, BITS = 40, 4, 1024
WORDS = BITS // 64
LEAST_ESTIMATE = 0.55
# Differing bits of two sketches whose estimate is LEAST_ESTIMATE.
MOST_BITS = int(BITS / 2 * (1 - math.exp(-4 * BANDS * ROWS * (1 - LEAST_ESTIMATE) / BITS)))
BROADCAST_ROWS = 300_000  # of one or two numbers each
BROADCAST_BYTES = 16 << 20
SMALL = 24  # members of a group that are always compared pair by pair
PAIRS = 12  # pairs per member of open buckets that a round may compare in larger groups
# Rows that a partition is worth: numbers; elements of sets; sketches or short sets; pairs with both of their sets.
NUMBERS, ELEMENTS, SHORT, FULL = 300_000, 500_000, 50_000, 5_000

SIGNATURE = "doc_id long, digest binary, n long, high long, low long, keys array<long>, sketch array<long>"


def sized(df: DataFrame) -> DataFrame:
    """With a broadcast hint if the rows, which must be written already, are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def written(df: DataFrame, name: str, rows: int, per: int = NUMBERS) -> DataFrame:
    """``stage`` of at most about ``rows`` rows, in no more partitions than these are worth."""
    return packed(stage(packed(df, rows, per), name), rows, per)


def signatures(texts: DataFrame, width: int = 5) -> DataFrame:
    """SIGNATURE of every (doc_id, digest, text)."""
    longs = pa.list_(pa.int64())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(BANDS, ROWS, BITS)
        none = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                n, high, low, keys, sketches = [], [], [], [], []
                for text in some.column(2).to_pylist():
                    hashes = shingles(text, width)
                    n.append(len(hashes))
                    a, b = set_hash(hashes)
                    high.append(a)
                    low.append(b)
                    samples = hasher.samples(hashes) if len(hashes) else None
                    keys.append(none if samples is None else hasher.keys(samples))
                    sketches.append(none if samples is None else hasher.sketch(samples))
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), pa.array(n, pa.int64()), pa.array(high, pa.int64()),
                    pa.array(low, pa.int64()), pa.array(keys, longs), pa.array(sketches, longs),
                ], names=["doc_id", "digest", "n", "high", "low", "keys", "sketch"])

    return texts.mapInArrow(tidy(sign), SIGNATURE)


def shingle_sets(texts: DataFrame, width: int = 5) -> DataFrame:
    """(id, hashes): the sorted set of each text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [shingles(t, width) for t in some.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([some.column(0), held], names=["id", "hashes"])

    return texts.mapInArrow(tidy(sets), "id long, hashes array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The written pairs (a, b) whose full sets are similar enough.

    Few pairs are broadcast, so that of all sets only those that are asked for move.
    """
    rows = pairs.count()
    some = F.broadcast if rows <= BROADCAST_ROWS else lambda df: df
    left = sets.withColumnsRenamed({"id": "a", "hashes": "hashes_a"}).join(some(pairs), "a")
    asked = packed(pairs, rows, NUMBERS).select("b").distinct()
    right = sets.withColumnsRenamed({"id": "b", "hashes": "hashes_b"}).join(some(asked), "b", "left_semi")
    overlap = F.size(F.array_intersect("hashes_a", "hashes_b"))
    both = left.join(right, "b").select("a", "b", (F.size("hashes_a") + F.size("hashes_b")).alias("n"), overlap.alias("overlap"))
    return packed(both, rows, FULL).where(100 * F.col("overlap") >= percent * (F.col("n") - F.col("overlap"))).select("a", "b")


def differing(left: Column, right: Column) -> Column:
    """Differing bits of two odd sketches."""
    return sum((F.bit_count(F.get(left, i).bitwiseXOR(F.get(right, i))) for i in range(WORDS)), F.lit(0))


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, root) of the buckets whose members are in several components."""
    rows = members.count()
    within = written(
        members.join(sized(labels), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "bucket-roots", rows
    )
    mixed = within.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
    return written(within.join(mixed, "key", "left_semi"), "open-buckets", rows)


def exploded(rows: DataFrame) -> DataFrame:
    """(g, id, h) of every element of the sets ``d`` of (g, id, d)."""
    return rows.select("g", "id", F.explode("d").alias("h"))


def differences(rows: DataFrame) -> DataFrame:
    """(g, id, root, n, d, m): the ``m`` elements in which ``d`` and the group's ``centre`` differ."""
    centre = F.coalesce("centre", F.array().cast("array<long>"))
    differing_elements = F.concat(F.array_except("d", centre), F.array_except(centre, F.col("d")))
    return rows.select("g", "id", "root", "n", differing_elements.alias("d")).withColumn("m", F.size("d").cast("long"))


def with_roots(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(g, id, n, d, z, reach, root, size) of the groups that hold several components."""
    rows = stage(
        groups.join(sized(labels), "id", "left").select("g", "id", "n", "d", "z", "reach", F.coalesce("root", "id").alias("root")), "groups"
    )
    number = rows.count()
    sizes = packed(rows.select("g", "root"), number, NUMBERS).groupBy("g").agg(
        F.count("*").alias("size"), F.min("root").alias("r"), F.max("root").alias("s")
    )
    mixed = written(sizes.where("r < s").select("g", "size"), "mixed-groups", number)
    return stage(rows.join(sized(mixed), "g"), "open-groups")


def with_partners(able: DataFrame, common: DataFrame, more: int, number: int) -> DataFrame:
    """The members (g, id, z, star, inside) with ``c`` common elements that can have a link to look for.

    Common elements bound the overlap: partners have z1 <= reach2 and z2 <= reach1, with reach = 2 * more * c - z.
    Two members that are ``inside`` the component of their group's star need no link. Whether there is
    a partner depends on a member's numbers only, so it is found on the distinct ones, whose
    number is bounded by the length of the texts.
    """
    per_member = common.groupBy("g", "id").agg(F.count("*").alias("c"))
    rows = able.join(per_member, ["g", "id"]).withColumn("reach", 2 * more * F.col("c") - F.col("z"))
    rows = written(rows.where("reach >= star.z"), "reaches", number)
    kinds = written(rows.select("g", "inside", "z", "reach").distinct(), "kinds", number)
    points = kinds.select("g", F.col("z").alias("at"), F.lit(0).alias("asks"), "inside", "z", "reach")
    asks = kinds.select("g", F.col("reach").alias("at"), F.lit(1).alias("asks"), "inside", "z", "reach")
    before = Window.partitionBy("g").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    best = lambda inside: F.max(F.when((F.col("asks") == 0) & (F.col("inside") == inside), F.col("reach"))).over(before)
    seen = points.unionByName(asks).withColumn("within", best(True)).withColumn("without", best(False))
    enough = F.when(F.col("inside"), F.col("without")).otherwise(F.greatest("within", "without")) >= F.col("z")
    found = written(seen.where(F.col("asks").eqNullSafe(1) & enough).select("g", "inside", "z", "reach"), "partners", number)
    return rows.join(sized(found), ["g", "inside", "z", "reach"], "left_semi").drop("reach")


def narrow(large: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, smaller groups) of groups (g, id, n, d, root, size), by differences to their centres.

    With m differing elements and z = (100 + percent) m - (100 - percent) n, two members are linked
    exactly when z1 + z2 <= 2 (100 + percent) |D1 and D2|. So those with z1 + z2 <= 0 are linked
    without a look, to the member of the least z. All others must share elements of D.
    """
    more, less = 100 + percent, 100 - percent
    number, elements = large.agg(F.count("*"), F.sum(F.size("d"))).first()
    held = packed(exploded(large).groupBy("g", "h").agg(F.count("*").alias("c")), elements, ELEMENTS)
    of_groups = packed(large.select("g", "size"), number, NUMBERS)
    sizes = written(of_groups.groupBy("g").agg(F.first("size").alias("size")), "group-sizes", number)
    centres = held.join(sized(sizes), "g").where("2 * c > size").groupBy("g").agg(F.collect_list("h").alias("centre"))
    centres = stage(packed(centres, elements, ELEMENTS), "centres")
    rows = stage(differences(large.join(few_bytes(centres, 8 * F.size("centre")), "g", "left")), "differences")
    z = more * F.col("m") - less * F.col("n")
    rows = rows.withColumn("z", z)
    elements = rows.agg(F.sum("m")).first()[0]
    numbers = packed(rows.select("g", "id", "root", "z"), number, NUMBERS)
    middle = written(numbers.groupBy("g").agg(F.min(F.struct("z", "id", "root")).alias("star")), "stars", number)
    near = numbers.join(sized(middle), "g")
    links = near.where("z + star.z <= 0 AND id <> star.id").select(F.least("id", "star.id").alias("a"), F.greatest("id", "star.id").alias("b"))
    able = near.selectExpr("g", "id", "z", "star", "root = star.root OR z + star.z <= 0 AS inside")
    common = packed(stage(exploded(rows), "difference-elements"), elements, ELEMENTS)
    for _ in range(2):  # the elements of members without a partner count no longer
        df = common.groupBy("g", "h").agg(F.count("*").alias("df")).where("df > 1")
        common = written(common.select("g", "id", "h").join(df, ["g", "h"]), "common-elements", elements, ELEMENTS)
        able = written(with_partners(able.drop("c"), common, more, number), "able", number)
        common = common.join(sized(able.select("g", "id")), ["g", "id"], "left_semi")
    # The rarest elements first: partners share one of the first m - overlap + 1, which begin with those of one member only.
    least = F.greatest(F.lit(1), F.ceil((F.col("z") + F.col("star.z")) / (2 * more)))
    able = able.select("g", "id", "z", "c", (F.col("c") - least + 1).alias("prefix"))
    order = Window.partitionBy("g", "id").orderBy("df", "h")
    first = common.join(sized(able), ["g", "id"]).withColumn("at", F.row_number().over(order)).where("at <= prefix")
    # Two members share no more than what follows their first common element, so each then has a reach for the other's z.
    reach = 2 * more * (1 + F.col("c") - F.col("at")) - F.col("z")
    first = first.select("g", "id", F.xxhash64("g", "h").alias("sub"), "df", "h", "z", reach.alias("reach"))
    members = written(first, "sharing", elements, ELEMENTS)
    # Elements that the same members share, such as those around one edit, give one group, that of the first one.
    bounds = [F.min("z").alias("low"), F.max("reach").alias("far"), F.first("df").alias("df"), F.first("h").alias("h")]
    alike = [F.count("*").alias("size"), *bounds, *[F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)]]
    subs = members.groupBy("g", "sub").agg(*alike).where("size > 1").groupBy("g", "size", "s1", "s2").agg(F.min(F.struct("df", "h", "sub", "low", "far")).alias("of"))
    members = members.join(sized(written(subs.select("of.sub", "of.low", "of.far"), "subs", elements, ELEMENTS)), "sub")
    members = members.where("z <= far AND reach >= low").select("g", "sub", "id", "z", "reach")
    members = written(members, "sub-members", elements, ELEMENTS)
    smaller = members.join(rows.select("g", "id", "n", "d"), ["g", "id"]).select(F.col("sub").alias("g"), "id", "n", "d", "z", "reach")
    return links, stage(packed(smaller, members.count(), SHORT), "smaller-groups")


def few_bytes(df: DataFrame, size: Column) -> DataFrame:
    """With a broadcast hint if the written rows have few enough bytes."""
    total = df.agg(F.sum(size + 16)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def pairwise_size(rows: DataFrame, members: int) -> int:
    """Groups up to this size are compared pair by pair: all their pairs of two components are linear in the members."""
    rows = packed(rows.select("g", "root", "size"), rows.count(), NUMBERS)
    parts = rows.groupBy("g", "root").agg(F.count("*").alias("c"), F.first("size").alias("size"))
    groups = parts.groupBy("g").agg(F.first("size").alias("size"), F.sum(F.col("c") * F.col("c")).alias("inside"))
    across = (F.col("size") * F.col("size") - F.col("inside")) / 2
    classes = groups.groupBy(F.ceil(F.log2("size")).alias("k")).agg(F.sum(across).alias("pairs"))
    limit, total = SMALL, 0.0
    for k, pairs in sorted(map(tuple, classes.collect())):
        total += pairs
        if total > PAIRS * members:
            break
        limit = max(limit, 2**k)
    return limit


def late_links(mixed: DataFrame, sets: DataFrame, sketches: DataFrame, links: DataFrame, labels: DataFrame, percent: int):
    """(links, labels) with the links between members of different components in open buckets.

    Buckets that share members form a group. Small groups are compared pair by pair (``pairwise_size``).
    A larger one is narrowed down: see ``narrow``. Its smaller groups hold the members that
    share an element of their differences, which is at most half of it, so the rounds come to an end.
    """
    ends = mixed.groupBy("key").agg(F.min("id").alias("a"))
    edges = mixed.join(ends, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    groups = components(edges, mixed.count()).select("id", F.col("root").alias("g"))
    groups = sets.join(sized(stage(groups, "group-ids")), "id").select(
        "g", "id", F.size("hashes").cast("long").alias("n"), F.col("hashes").alias("d"),
        F.lit(None).cast("long").alias("z"), F.lit(None).cast("long").alias("reach"),
    )
    members = sketches.count()
    bits = packed(sketches.select("id", "sketch"), members, SHORT)
    while True:
        rows = with_roots(groups, labels)
        if not rows.limit(1).count():
            return links, labels
        limit = pairwise_size(rows, members)
        small = rows.where(F.col("size") <= limit).select("g", "id", "root", "n", F.size("d").alias("m"), "z", "reach")
        small = packed(small, rows.count(), SHORT)
        left, right = (
            small.select("g", F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("root", "n", "m", "z", "reach")])
            for c in "ab"
        )
        # Sets that differ by so many elements in size differ in as many at least.
        fits = (100 + percent) * F.abs(F.col("m_a") - F.col("m_b")) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
        # In a group of a round, members without a look from both sides meet in that of an earlier common element, or nowhere.
        fits &= F.coalesce(F.expr("z_a <= reach_b AND z_b <= reach_a"), F.lit(True))
        pairs = left.join(right, "g").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & fits)
        pairs = written(pairs.select("a", "b").distinct(), "open-pairs", PAIRS * members)
        of = lambda c: bits.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}"))
        close = pairs.join(of("a"), "a").join(of("b"), "b").where(differing(F.col("sketch_a"), F.col("sketch_b")) <= MOST_BITS)
        late = confirm(written(close.select("a", "b"), "close-pairs", PAIRS * members), sets, percent)
        groups = rows.where(F.col("size") > limit)
        if groups.limit(1).count():
            sure, groups = narrow(groups, percent)
            late = late.unionByName(sure)
        else:
            groups = None
        late = stage(late, "late-links")
        if late.limit(1).count():
            links = links.unionByName(late)
            labels = components(links, links.count())
        if groups is None:
            return links, labels


def digest(text: str) -> Column:
    """128 bits of a text; null if it is null."""
    return F.unhex(F.md5(F.col(text)))


def near_rows(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, kept, first) per row.

    ``first`` is true for one (doc_id, digest) of each component only, ``kept`` for all rows of
    the component's smallest id if it has one.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    signed = stage(signatures(texts), "signatures")
    number = signed.count()
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest"))
    sets_of = signed.where("n > 0").groupBy("high", "low").agg(smallest.alias("rep")).select("high", "low", "rep.*")
    ordered = sets_of.orderBy("nameless", "doc_id", "high", "low").select(
        F.monotonically_increasing_id().alias("id"), "high", "low", F.col("doc_id").alias("rep_doc"),
        F.col("digest").alias("rep_digest"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("at"),
    )
    nodes = stage(packed(ordered, number, SHORT // 2), "nodes")
    named = (
        signed.select("doc_id", "digest", "n", "high", "low")
        .join(nodes.select("high", "low", "id", "rep_doc", "rep_digest"), ["high", "low"], "left")
        .select(
            "doc_id", "digest", "n", "id", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("rep_doc")).alias("rep_doc"),
            (F.col("id").isNull() | F.col("doc_id").eqNullSafe(F.col("rep_doc")) & (F.col("digest") == F.col("rep_digest")))
            .alias("is_rep"),
        )
    )
    named = stage(packed(named, number, SHORT // 2), "representatives")
    reps = nodes.select("id", "at", F.col("rep_digest").alias("digest"))
    at = F.coalesce("doc_id", F.lit(LAST_ID))
    distinct = signed.where("n > 0").withColumn("at", at).join(reps, ["at", "digest"])
    banded = distinct.select(F.explode("keys").alias("key"), "id")
    hubs = banded.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last")
    members = stage(packed(banded.join(hubs.select("key", "hub"), "key"), BANDS * number, NUMBERS), "buckets")
    filled = members.count()
    members = packed(members, filled, NUMBERS)
    ids = written(members.select("id").distinct(), "bucket-ids", filled)
    few, several = sized(ids), ids.count()
    sketches = written(
        distinct.join(few, "id", "left_semi").select("id", "n", "sketch").dropDuplicates(["id"]), "sketches", several, SHORT
    )
    wanted = sized(stage(reps.join(few, "id", "left_semi"), "wanted-rows"))
    rows_of = texts.withColumn("at", at).join(wanted, ["at", "digest"]).select("id", "text")
    sets = stage(shingle_sets(rows_of), "shingle-sets")
    if sets.count() > several:  # repeated rows
        sets = stage(sets.dropDuplicates(["id"]), "distinct-sets")

    of = lambda c: sketches.select(*[F.col(x).alias(f"{x}_{c}" if x != "id" else c) for x in ("id", "n", "sketch")])
    pairs = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    close = pairs.join(of("a"), "a").join(of("b"), "b").where(
        (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (differing(F.col("sketch_a"), F.col("sketch_b")) <= MOST_BITS)
    )
    close = written(close.select("a", "b"), "candidates", filled)
    links = stage(confirm(close, sets, percent), "links")
    labels = components(links, links.count())

    links, labels = late_links(open_buckets(members, labels), sets, sketches, links, labels, percent)
    # A component's root is its smallest number, which has its smallest id.
    heads = stage(
        labels.select(F.col("root").alias("id")).distinct().join(nodes, "id")
        .select(F.col("id").alias("root"), F.col("rep_doc").alias("head")), "heads",
    )
    linked = labels.join(sized(heads), "root").select("id", "root", "head")
    component = F.when(F.col("root").isNull(), F.col("rep_doc")).otherwise(F.col("head"))
    first = F.col("is_rep") & F.coalesce(F.col("root") == F.col("id"), F.lit(True))
    return named.join(linked, "id", "left").select(
        "doc_id", "digest", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.when(F.col("doc_id").isNull(), first).otherwise(F.col("doc_id") == component).alias("kept"),
        first.alias("first"),
    )


def near_duplicates(
    docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document."""
    return near_rows(docs, percent, id_col, text_col).drop("digest", "first")


# Brute force over all pairs that share a shingle; meant for small tables.
OP2_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
         ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * m >= 75 * (p.n + q.n - m)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS reach FROM t UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op2_near_dedup", OP2_SQL)
def op2_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_duplicates(documents(spark, sf))
