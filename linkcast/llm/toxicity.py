"""Toxicity from confirmed examples and unlabelled text: non-negative positive-unlabelled learning.

Only positive labels are examples. All other text is unlabelled, toxic or not, and the risk of a
classifier g is estimated with the class prior p as

    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]),    l(z) = log(1 + exp(-z)).

The bracket is the risk on clean text, which cannot be negative; when a step finds it so, it
goes uphill on it (Kiryo and others 2017). ``members`` linear classifiers are trained in
numpy with different shares of the unlabelled sample, and their logits averaged; the score is the
logistic function of it.

* A text is the set of its words (runs of letters, lower-cased) and of their beginnings of
  ``PREFIXES`` characters, each as a 64-bit hash. Whole texts are read; a word is never cut up to
  a million letters.
* Candidates are the features that at least ``least`` confirmed examples of the sample hold. Their document
  frequencies are counted over all documents; the at most ``features`` that confirmed examples
  hold more often with a log-likelihood ratio of more than ``evidence`` are used.
* The classifiers are fitted on a bounded sample of distinct texts: at most ``positives``
  confirmed examples and ``unlabelled`` texts of all documents, picked by a hash of the text.
* The prior, unless given, is the share, less its standard error, of toxic ones among the
  distinct labelled texts: a prior that is too large makes clean text look toxic.

Labels are learnt only from rows of ``labels`` whose crc32(id as text) mod 3 is not 1, so not from
rows without an id. Of several labels of a text the largest holds; null labels are none. Null and
empty texts have no features and get the score of the intercept. Without a confirmed example,
or a feature that tells them apart, every score is 0. Repeated rows get repeated rows; an empty
table gives an empty result. Other columns are carried as they are, a column of the name of the
score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkcast.llm.common import documents, query, slices
from linkcast.llm.shingles import BASE, mix
from linkcast.session import stage

PREFIXES = (4, 5, 6)
PART = 1 << 20  # characters turned into numbers at once
CANDIDATES = 200_000
FILTER_BITS = 22

_LETTERS: list[np.ndarray] = []
UP = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PREFIXES[-1] - 1, BASE, np.uint64)]))


def letters() -> np.ndarray:
    """Whether each code point is a letter; built once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def parts(texts: list[str | None]) -> Iterator[tuple[str, list[int], list[int]]]:
    """Texts in lower case, joined to parts of about PART: (part, owners, where each owner begins)."""
    group, owners, starts, size = [], [], [], 0
    for owner, text in enumerate(texts):
        text = (text or "").lower()
        at = 0
        while at < len(text):
            end = min(len(text), at + PART)
            last = min(len(text), end + PART)
            while end < last and text[end].isalpha():
                end += 1
            group.append(text[at:end])
            owners.append(owner)
            starts.append(size)
            size += end - at + 1
            at = end
            if size >= PART:
                yield "\n".join(group), owners, starts
                group, owners, starts, size = [], [], [], 0
    if group:
        yield "\n".join(group), owners, starts


def hashed(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, hash) of the words and word beginnings of the texts, with repeats."""
    known = letters()
    for part, owners, begins in parts(texts):
        chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known[chars], [False]])))
        start, end = edges[::2], edges[1::2]
        if not len(start):
            continue
        owner = np.array(owners)[np.searchsorted(begins, start, side="right") - 1]
        size = end - start
        # Polynomials of the characters from the start of each word.
        lead = np.concatenate([[0], start])
        within = np.arange(len(chars)) - np.repeat(lead, np.diff(np.append(lead, len(chars))))
        longest = int(size.max())
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest - 1, BASE, np.uint64)])) if longest > 1 else UP[:1]
        value = np.where(known[chars], (chars.astype(np.uint64) + np.uint64(1)) * up[np.minimum(within, longest - 1)], np.uint64(0))
        total = np.add.reduceat(value, start)
        yield owner, mix(total, 7)
        for n in PREFIXES:
            some = np.flatnonzero(size >= n)
            first = sum((chars[start[some] + j].astype(np.uint64) + np.uint64(1)) * UP[j] for j in range(n))
            if len(some):
                yield owner[some], mix(first, n)


class Features:
    """A sorted set of hashes, to find which of them each text holds."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.hashes)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (owner, place in ``hashes``), in order of the owner."""
        size = max(1, len(self.hashes))
        found = [np.zeros(0, np.int64)]
        for owner, h in hashed(texts):
            maybe = np.flatnonzero(self.filter[self._slot(h)])
            h, owner = h[maybe], owner[maybe]
            place = np.minimum(np.searchsorted(self.hashes, h), size - 1)
            if len(self.hashes):
                same = self.hashes[place] == h
                found.append(np.unique(owner[same].astype(np.int64) * size + place[same]))
        both = np.unique(np.concatenate(found))
        return both // size, both % size


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    intercept: float
    prior: float
    sizes: dict = field(default_factory=dict)  # of the samples, for reports

    def score(self, texts: list[str | None], features: Features) -> np.ndarray:
        if not self.prior:
            return np.zeros(len(texts))
        owner, place = features.find(texts)
        logit = np.bincount(owner, self.weights[place], len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64)


def nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float,
    steps: int = 400, rate: float = 0.05, decay: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and intercept of one linear classifier, by Adam on the non-negative risk of all rows."""
    (in_u, at_u), (in_p, at_p) = flat(unlabelled), flat(positive)
    w, moment, square = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        gu = np.bincount(in_u, w[at_u], len(unlabelled)) + w[-1]
        gp = np.bincount(in_p, w[at_p], len(positive)) + w[-1]
        up, down = 1 / (1 + np.exp(-np.clip(gu, -500, 500))), 1 / (1 + np.exp(-np.clip(gp, -500, 500)))
        clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # Derivatives by g: l(-g) gives sigma(g), l(g) gives sigma(g) - 1.
        du, dp = up / len(gu), -prior * down / len(gp)
        if clean < 0:
            du, dp = -du, -dp
        else:
            dp = dp + prior * (down - 1) / len(gp)
        grad = np.bincount(at_u, du[in_u], size + 1) + np.bincount(at_p, dp[in_p], size + 1)
        grad[:-1] += decay * w[:-1]
        grad[-1] = du.sum() + dp.sum()
        moment += 0.1 * (grad - moment)
        square += 0.01 * (grad**2 - square)
        pace = rate * min(1, 2 * (1 - step / steps))
        w -= pace * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(h, toxic): every distinct text by its hash, with the largest label it has in the training folds, if any."""
    texts = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("h")
    ).distinct()
    known = labels.where(F.col(id_col).isNotNull() & ~_held_out(id_col) & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    named = texts.where("doc IS NOT NULL").join(known, "doc", "left").select("h", "toxic")
    nameless = texts.where("doc IS NULL").select("h", F.lit(None).cast("int").alias("toxic"))
    return stage(named.unionByName(nameless).groupBy("h").agg(F.max("toxic").alias("toxic")), "labelled-texts")


def pick(texts: DataFrame, most: int, salt: int) -> tuple[list[int], int]:
    """At most ``most`` of the text hashes, by another hash, and how many there are."""
    count = texts.count()
    place = F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(1 << 30))
    # A bit more than wanted pass the filter, so that the sort sees a bounded number.
    share = min(1.0, (1.1 * most + 1_000) / max(1, count))
    chosen = texts.where(place < int(share * (1 << 30))).orderBy(place, "h").select("h").limit(most)
    return [r["h"] for r in chosen.collect()], count


def _sample(docs: DataFrame, text_col: str, hashes: list[int]) -> DataFrame:
    """(h, text) of the texts with one of the hashes."""
    wanted = docs.sparkSession.createDataFrame([(h,) for h in hashes], "h long")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(wanted), "h").groupBy("h").agg(F.min("text").alias("text"))


def _held(rows: DataFrame, features: Features) -> dict[int, np.ndarray]:
    """Places of the features per text hash of a bounded sample."""
    shared = rows.sparkSession.sparkContext.broadcast(features.hashes)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(shared.value)
        for batch in batches:
            for some in slices(batch, 1):
                owner, place = known.find(some.column(1).to_pylist())
                cuts = np.searchsorted(owner, np.arange(1, some.num_rows))
                raw = [x.astype("<i4").tobytes() for x in np.split(place, cuts)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(raw, pa.binary())], names=["h", "places"])

    found = rows.mapInArrow(find, "h long, places binary").collect()
    shared.unpersist()
    return {r["h"]: np.frombuffer(r["places"], "<i4") for r in found}


def train(
    docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = 4_000, unlabelled: int = 12_000,
    features: int = 8_192, least: int = 3, evidence: float = 12.0, members: int = 3,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Features from all documents, classifiers from the bounded samples."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.0)
    texts = labelled_texts(docs, labels, id_col, text_col, label_col)
    confirmed, n_toxic = pick(texts.where("toxic = 1"), positives, 1)
    if not confirmed:
        return none
    others, n_texts = pick(texts, unlabelled, 2)
    if prior is None:
        known = texts.where("toxic IS NOT NULL").count()
        share = n_toxic / known
        prior = share - (share * (1 - share) / known) ** 0.5
    prior = min(max(prior, 1e-4), 0.9)
    spark = docs.sparkSession

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, 256, 1 << 20):
                ids = some.column(0).to_numpy()
                for owner, h in hashed(some.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(h.view(np.int64))], names=["h", "f"])

    seen = _sample(docs, text_col, confirmed).mapInArrow(explode, "h long, f long").distinct()
    enough = seen.groupBy("f").count().where(F.col("count") >= min(least, len(confirmed)))
    found = stage(enough.orderBy(F.desc("count"), "f").limit(CANDIDATES), "toxic-candidates").collect()
    candidates = Features(np.array([r["f"] for r in found], np.int64).view(np.uint64))
    in_toxic = np.zeros(len(candidates.hashes))
    for r in found:
        in_toxic[np.searchsorted(candidates.hashes, np.uint64(r["f"] % (1 << 64)))] = r["count"]
    shared = spark.sparkContext.broadcast(candidates.hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(shared.value)
        total = np.zeros(len(known.hashes) + 1, np.int64)
        for batch in batches:
            for some in slices(batch, 0):
                total[:-1] += np.bincount(known.find(some.column(0).to_pylist())[1], minlength=len(known.hashes))
                total[-1] += some.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n"))
    totals = dict(map(tuple, counted.collect()))  # at most CANDIDATES and one
    shared.unpersist()
    n = totals.pop(len(candidates.hashes), 0)
    df = np.array([totals.get(k, 0) for k in range(len(candidates.hashes))], float)
    expected = (df + 1) / (n + 2) * len(confirmed)
    more = in_toxic > expected
    found_more = np.where(more, 2 * (in_toxic * np.log(in_toxic / expected) - in_toxic + expected), 0)
    best = np.argsort(-found_more, kind="stable")[:features]
    best = np.sort(best[found_more[best] > evidence])
    if not len(best):
        return none
    used = Features(candidates.hashes[best])
    places = _held(_sample(docs, text_col, sorted({*confirmed, *others})), used)
    p, u = [places[h] for h in confirmed], [places[h] for h in others]
    fits = []
    for m in range(members):
        some = [x for k, x in enumerate(u) if members == 1 or k % members != m or len(u) < 2 * members]
        fits.append(nnpu(p, some, len(best), prior))
    weights, intercept = np.mean([w for w, _ in fits], axis=0), float(np.mean([b for _, b in fits]))
    sizes = {"texts": n_texts, "confirmed": n_toxic, "positives": len(p), "unlabelled": len(u), "candidates": len(found)}
    return Model(used.hashes, weights, intercept, prior, sizes)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The input's columns and the score of every text."""
    kept = docs.drop(out_col)
    at = kept.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``features`` numbers

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = Features(model.hashes)
        for batch in batches:
            for some in slices(batch, at):
                found = model.score(some.column(at).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found)], names=[*some.schema.names, out_col])

    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.DoubleType())])
    return kept.mapInArrow(rate, schema)


@query("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document."""
    docs = documents(spark, sf)
    model = train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
