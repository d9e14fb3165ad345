"""Documents that leak benchmark items: BM25 retrieval with block-max WAND, then verification.

The benchmark's items form an inverted index. A posting's impact is its BM25 weight divided
by the score of the item against itself, so that a score says which share of the item's
weight a passage holds and one threshold fits items of any length. Documents are cut into
passages of twice the longest item, half overlapping, so that a whole item always lies in
one of them. Every passage of every document is a query:

1. frequent terms, taken while no item holds more than ``FREQUENT`` of its weight in them,
   are left out at first. The postings of the other terms are short; summed by passage and
   item, plus the item's weight in frequent terms, they bound every score. Passages without
   an item whose bound reaches the threshold end here (nearly all do);
2. block-max WAND moves over the postings of the others, skips blocks of postings whose
   largest impacts cannot reach the threshold, and returns *all* items that do;
3. each retrieved item is verified on the document's three-word shingles: at least
   ``question`` of those of its question and ``answer`` of those of its answer must occur.

Words are runs of ASCII letters, digits and all non-ASCII characters, with A-Z lower-cased.
The benchmark is text only; its last quarter of words (one at least) is taken as the answer.
The index of ``block_items`` items is broadcast at a time, larger benchmarks take several
passes over the documents. Statistics (document frequencies, mean length) cover all items.

Null or empty texts contain nothing; items without words are never found. Rows with a null
document id stay; repeated items are found each. Other columns of the documents are carried
as they are; a column with the name of the output is replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkcast.llm.common import documents, query, slices, tidy

K1, B = 1.2, 0.75
SHINGLE = 3
BLOCK = 32  # postings under one block maximum
FREQUENT = 0.3  # most of an item's weight that the frequent terms may hold
LEAK = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("question_overlap", T.DoubleType()),
    T.StructField("answer_overlap", T.DoubleType()),
    T.StructField("n_passages", T.LongType()),
]))
LEAK_ARROW = pa.list_(pa.struct([
    ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()),
    ("answer_overlap", pa.float64()), ("n_passages", pa.int64()),
]))
# Bytes of UTF-8: letters and digits of ASCII stay in lower case, its other characters separate.
WORD_BYTES = bytes(
    c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256)
)
NOT_WORD = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"  # the same for Spark


def words(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "replace").translate(WORD_BYTES)
    return [w for w in raw.split(b" ") if w]


class Index:
    """Postings of one block of items with impacts, block maxima and the shingles to verify."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n_items: int, mean_words: float):
        split = [(i, w) for i, t in items if (w := words(t))]
        self.item_ids = [i for i, _ in split]
        self.vocab = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        self.longest = max((len(ws) for _, ws in split), default=1)
        idf = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) for w in self.vocab}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocab]
        self.question, self.answer = [], []
        for k, (_, ws) in enumerate(split):
            norm = K1 * (1 - B + B * len(ws) / mean_words)
            weights = {w: idf[w] * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(ws).items()}
            total = sum(weights.values())
            for w, x in weights.items():
                postings[self.vocab[w]].append((k, x / total))
            ids = [self.vocab[w] for w in ws]
            cut = len(ids) - max(1, len(ids) // 4)
            self.question.append(self.shingles(np.array(ids[:cut], np.int64)))
            self.answer.append(self.shingles(np.array(ids[cut:], np.int64)))
        self.items = [[k for k, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.block_max = [[max(x[a: a + BLOCK]) for a in range(0, len(x), BLOCK)] for x in self.impacts]
        self.bound = [max(x) for x in self.impacts]
        # Frequent terms first; the rest with their postings one after another.
        self.frequent_part = np.zeros(len(split))
        self.rare = np.ones(len(self.vocab), bool)
        for t in sorted(range(len(self.vocab)), key=lambda t: (-len(self.items[t]), t)):
            more = self.frequent_part[self.items[t]] + self.impacts[t]
            if more.max() > FREQUENT:
                break
            self.frequent_part[self.items[t]] = more
            self.rare[t] = False
        sizes = [len(x) if r else 0 for x, r in zip(self.items, self.rare)]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rare_items = np.array([k for x, r in zip(self.items, self.rare) if r for k in x], np.int64)
        self.rare_impacts = np.array([i for x, r in zip(self.impacts, self.rare) if r for i in x])

    def shingles(self, ids: np.ndarray) -> set[tuple]:
        """Shingles as tuples of term numbers; a shorter text is one shingle."""
        if len(ids) <= SHINGLE:
            return {tuple(ids.tolist())} if len(ids) else set()
        return set(zip(*(ids[j: len(ids) - SHINGLE + 1 + j].tolist() for j in range(SHINGLE))))

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose impacts over the distinct terms add up to the threshold."""
        at = [[self.items[t][0], 0, t] for t in terms]  # (item at the cursor, place, term)
        found = []

        def seek(cursor: list, item: int) -> None:
            place = bisect_left(self.items[cursor[2]], item, cursor[1])
            cursor[1] = place
            cursor[0] = self.items[cursor[2]][place] if place < len(self.items[cursor[2]]) else -1

        while at:
            at.sort()
            total, pivot = 0.0, -1
            for k, cursor in enumerate(at):
                total += self.bound[cursor[2]]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == item:
                pivot += 1
            possible, upto = 0.0, len(self.item_ids)
            for cursor in at[: pivot + 1]:
                block = bisect_left(self.items[cursor[2]], item, cursor[1]) // BLOCK
                if block < len(self.block_max[cursor[2]]):
                    possible += self.block_max[cursor[2]][block]
                    ends = min(len(self.items[cursor[2]]), (block + 1) * BLOCK) - 1
                    upto = min(upto, self.items[cursor[2]][ends] + 1)
            if possible < threshold:
                if pivot + 1 < len(at):
                    upto = min(upto, at[pivot + 1][0])
                for cursor in at[: pivot + 1]:
                    seek(cursor, max(upto, item + 1))
            elif at[0][0] == item:
                score = 0.0
                for cursor in at[: pivot + 1]:
                    score += self.impacts[cursor[2]][cursor[1]]
                    seek(cursor, item + 1)
                if score >= threshold:
                    found.append((item, score))
            else:
                for cursor in at[:pivot]:
                    if cursor[0] < item:
                        seek(cursor, item)
            at = [c for c in at if c[0] >= 0]
        return found

    def leaks(self, text: str | None, threshold: float, question: float, answer: float) -> list[dict]:
        """Verified items of a whole document, in order of their ids."""
        known = self.vocab
        ids = np.array([known.get(w, -1) for w in words(text)], np.int64)
        places = np.flatnonzero(ids >= 0)
        scores: dict[int, list[float]] = {}
        # Passage k holds the words from k to k + 2 strides; a word is in passages k and k - 1.
        stride = max(16, self.longest)
        for k in self.possible(ids, places, stride, threshold):
            a, b = np.searchsorted(places, [k * stride, (k + 2) * stride])
            terms = np.unique(ids[places[a:b]]).tolist()
            for item, score in self.retrieve(terms, threshold):
                scores.setdefault(item, []).append(score)
        if not scores:
            return []
        own = self._own_shingles(ids)
        out = []
        for item, found in scores.items():
            share = [self._share(own, ids, part[item]) for part in (self.question, self.answer)]
            if share[0] >= question and share[1] >= answer:
                out.append({
                    "item_id": self.item_ids[item], "score": round(max(found), 6),
                    "question_overlap": round(share[0], 6), "answer_overlap": round(share[1], 6),
                    "n_passages": len(found),
                })
        return sorted(out, key=lambda x: (x["item_id"] is None, x["item_id"]))

    def possible(self, ids: np.ndarray, places: np.ndarray, stride: int, threshold: float) -> list[int]:
        """Passages in which the bound of an item reaches the threshold."""
        places = places[self.rare[ids[places]]]
        if not len(places):
            return []
        n_terms, n_items = len(self.vocab), len(self.item_ids)
        passage, term = places // stride, ids[places]
        keys = np.unique(np.concatenate([passage * n_terms + term, np.maximum(passage - 1, 0) * n_terms + term]))
        passage, term = keys // n_terms, keys % n_terms
        size = self.first[term + 1] - self.first[term]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.first[term] - (ends - size), size)
        pairs, where = np.unique(np.repeat(passage, size) * n_items + self.rare_items[at], return_inverse=True)
        bound = np.bincount(where, weights=self.rare_impacts[at]) + self.frequent_part[pairs % n_items]
        return np.unique(pairs[bound >= threshold - 1e-9] // n_items).tolist()

    @staticmethod
    def _own_shingles(ids: np.ndarray) -> set[tuple]:
        n = len(ids) - SHINGLE + 1
        if n < 1:
            return set()
        full = np.ones(n, bool)
        for j in range(SHINGLE):
            full &= ids[j: n + j] >= 0
        at = np.flatnonzero(full)
        return set(zip(*(ids[at + j].tolist() for j in range(SHINGLE))))

    @staticmethod
    def _share(own: set[tuple], ids: np.ndarray, wanted: set[tuple]) -> float:
        if not wanted:
            return 1.0
        hits = 0
        for s in wanted:
            if len(s) == SHINGLE:
                hits += s in own
            else:  # a part of fewer words: they must follow each other
                n = len(ids) - len(s) + 1
                hits += n > 0 and bool(np.logical_and.reduce([ids[j: n + j] == x for j, x in enumerate(s)]).any())
        return hits / len(wanted)


def build(items: DataFrame, block_items: int = 50_000, id_col: str = "item_id", text_col: str = "text") -> list[Index]:
    """Indexes of at most ``block_items`` items each, with statistics over all items."""
    known = items.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")
    )
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = known.select("item_id", "text", F.filter(F.split(lower, NOT_WORD), lambda w: w != "").alias("words"))
    n, mean = split.where(F.size("words") > 0).agg(F.count("*"), F.avg(F.size("words"))).first()
    blocks = -(-n // block_items)
    found = []
    for k in range(blocks):
        mine = split.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        terms = mine.select(F.explode("words").alias("word")).distinct()
        df = (
            split.select(F.explode(F.array_distinct("words")).alias("word"))
            .join(terms, "word", "left_semi").groupBy("word").count()
        )
        table = {r["word"].encode(): r["count"] for r in df.collect()}
        rows = [(r["item_id"], r["text"]) for r in mine.select("item_id", "text").collect()]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        found.append(Index(rows, table, n, float(mean)))
    return found


def find_leaks(
    docs: DataFrame, indexes: list[Index], threshold: float = 0.5, question: float = 0.5, answer: float = 0.5,
    text_col: str = "text", out_col: str = "leaks",
) -> DataFrame:
    """The input's columns and ``out_col``: the verified items of each document."""
    kept = docs.drop(out_col)
    at = kept.columns.index(text_col)
    out = kept.withColumn(out_col, F.array().cast(LEAK))
    for index in indexes:
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most block_items items

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for some in slices(batch, at):
                    before = some.column(some.num_columns - 1).to_pylist()
                    found = [
                        old + index.leaks(text, threshold, question, answer)
                        for old, text in zip(before, some.column(at).to_pylist())
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [*some.columns[:-1], pa.array(found, LEAK_ARROW)], names=some.schema.names
                    )

        out = out.mapInArrow(tidy(search), T.StructType([*kept.schema.fields, T.StructField(out_col, LEAK)]))
    return out


def _sql_words(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"


OP4_SQL = f"""
WITH items AS (
  SELECT item_id, w, len(w) - greatest(1, len(w) // 4) AS cut
  FROM (SELECT item_id, {_sql_words("text")} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 12),
parts AS (
  SELECT item_id, 'q' AS part, w[1:cut] AS w FROM items
  UNION ALL SELECT item_id, 'a', w[cut + 1:] FROM items),
wanted AS (
  SELECT DISTINCT item_id, part, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS s
  FROM parts),
sizes AS (SELECT item_id, part, count(*) AS n FROM wanted GROUP BY ALL),
d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents WHERE text IS NOT NULL),
own AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS s
  FROM d WHERE len(w) >= 3),
hits AS (
  SELECT doc_id, item_id, part, count(*) AS n FROM own JOIN wanted USING (s) GROUP BY ALL),
shares AS (
  SELECT h.doc_id, h.item_id,
         max(h.n / z.n::DOUBLE) FILTER (h.part = 'q') AS q, max(h.n / z.n::DOUBLE) FILTER (h.part = 'a') AS a
  FROM hits h JOIN sizes z ON h.item_id = z.item_id AND h.part = z.part GROUP BY ALL)
SELECT doc_id, item_id, round(q, 6) AS question_overlap, round(a, 6) AS answer_overlap
FROM shares WHERE q >= 0.5 AND a >= 0.5
"""


@query("op4_decontamination", OP4_SQL)
def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the benchmark items that they leak.

    The SQL verifies every pair of a document and an item; the items of the given tables have
    more than twelve words, hence answers of at least three.
    """
    indexes = build(spark.read.parquet(f"{sf}/benchmark.parquet"))
    found = find_leaks(documents(spark, sf).select("doc_id", "text"), indexes)
    return found.select("doc_id", F.inline("leaks")).select("doc_id", "item_id", "question_overlap", "answer_overlap")
