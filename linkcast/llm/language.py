"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed 1- to 3-grams of its lower-cased characters (everything in
ASCII but letters counts as a space): log term frequency times inverse document frequency,
of unit length. Each language has ``clusters`` centroids from spherical k-means. The
prediction is the language of the centroid with the largest cosine, which is the score.
A text is *rejected* when its distance (one minus the cosine) is beyond its language's limit,
or when it is ``und``. The limit depends on the length, as short texts have few n-grams: texts
of 4, 8, ... or 128 characters and more leave ``reach`` times the cosine that 95 of 100 pieces
of so many characters reach, in the language's own sample or in all samples, whichever is less.
Pieces of 128 characters are clear enough; texts under 4 characters are only rejected as ``und``.

Document frequencies count every training document. The k-means runs on a sample of at most
``sample`` distinct training texts, shared evenly by the languages and picked by a hash of the
text. Training uses text and language of documents whose crc32(id as text) mod 4 is not 2.

A null text, or one without a letter, is ``und`` with score 0; so is every text when no
training document exists. Null languages and null ids are not trained on. Repeated rows give
repeated rows. Whole texts are read, in pieces of a million characters. Other columns are
carried as they are; a column that has the name of the output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from linkcast.llm.common import documents, query, slices, tidy
from linkcast.session import stage

BUCKETS = 4096
SHIFT = np.uint32(20)  # 32 bits less the 12 of a bucket
PIECE = 1 << 20
LENGTHS = tuple(2**k for k in range(2, 8))  # characters from which a limit holds
# Odd multipliers of the hashed n-grams, one row per n.
MULTIPLIERS = np.array([[0x9E3779B1, 0, 0], [0x85EBCA6B, 0xC2B2AE35, 0], [0x27D4EB2F, 0x165667B1, 0xD3A2646D]], np.uint32)
SPACE = np.arange(128, dtype=np.uint32)
SPACE[[c for c in range(128) if not chr(c).isalpha()]] = 32

RESULT = T.StructType([
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
])


def counts(text: str) -> np.ndarray:
    """Number of n-grams of a whole text per bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(text)), PIECE):
        piece = text[max(0, at - 2): at + PIECE].lower()
        chars = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.where(chars < 128, SPACE[np.minimum(chars, 127)], chars)
        for n in (1, 2, 3):
            m = len(chars) - n + 1
            if m > 0:
                grams = chars[:m] * MULTIPLIERS[n - 1, 0]
                for j in range(1, n):
                    grams = grams + chars[j: j + m] * MULTIPLIERS[n - 1, j]
                total += np.bincount(grams >> SHIFT, minlength=BUCKETS)
    return total


def pieces(text: str, place: int) -> list[str]:
    """One piece of each of LENGTHS that the text has, from anywhere in it."""
    found = []
    for size in LENGTHS:
        if len(text) >= size:
            at = place % (len(text) - size + 1)
            found.append(text[at: at + size])
    return found


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    languages: list[str]  # of each centroid
    limits: np.ndarray  # largest distance per centroid and length: under LENGTHS[0], then of each of LENGTHS

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        return unit(np.log1p(tf).astype(np.float32) * self.idf)

    def predict(self, texts: list[str | None]) -> list[dict]:
        out = [{"lang_pred": "und", "score": 0.0, "rejected": True} for _ in texts]
        if not self.languages:
            return out
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        for at in range(0, len(known), 256):
            some = known[at: at + 256]
            cosine = self.vectors(np.stack([counts(texts[i]) for i in some])) @ self.centroids.T
            best = cosine.argmax(axis=1)
            size = np.searchsorted(LENGTHS, [len(texts[i]) for i in some], side="right")
            for i, b, k, c in zip(some, best, size, cosine[np.arange(len(some)), best]):
                score = float(min(1.0, max(0.0, c)))
                out[i] = {
                    "lang_pred": self.languages[b], "score": round(score, 6),
                    "rejected": bool(1 - score > self.limits[b, k]),
                }
        return out


def spherical_kmeans(rows: np.ndarray, clusters: int, rounds: int = 20) -> np.ndarray:
    """Unit centroids of unit rows; starts from rows far from each other, in order."""
    start = [0]
    nearest = rows @ rows[0]
    for _ in range(1, min(clusters, len(rows))):
        start.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[start[-1]])
    centroids = rows[start]
    for _ in range(rounds):
        own = (rows @ centroids.T).argmax(axis=1)
        moved = unit(np.stack([rows[own == k].sum(axis=0) if (own == k).any() else c for k, c in enumerate(centroids)]))
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def floors(cosines: dict[str, list[list[float]]], reach: float) -> dict[str, np.ndarray]:
    """Least cosine per language and length class, from the cosines of pieces of each of LENGTHS."""
    least = {lang: np.zeros(1 + len(LENGTHS)) for lang in cosines}
    for k in range(len(LENGTHS)):
        every = [c for per_length in cosines.values() for c in per_length[k]]
        for lang, per_length in cosines.items():
            low = [float(np.quantile(c, 0.05)) for c in (per_length[k], every) if c]
            least[lang][k + 1] = max(reach * min(low), least[lang][k]) if low else least[lang][k]
    return least


def _held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    clusters: int = 3, sample: int = 2_400, reach: float = 0.6,
) -> Model:
    """Counts over all training documents, centroids from the bounded sample."""
    known = docs.where(
        F.col(id_col).isNotNull() & ~_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    ).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    none = Model(np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), [], np.zeros((0, 1 + len(LENGTHS))))
    # Distinct texts with a letter, so that copies neither fill a sample nor keep it empty.
    texts = stage(
        known.where(F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text").alias("h")).distinct(), "language-texts"
    )
    per_lang = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}
    if not per_lang:
        return none
    share = max(1, sample // len(per_lang))
    # A few more than wanted pass the filter, so that the ranking sees a bounded number.
    near = F.create_map(*[F.lit(x) for lang, n in sorted(per_lang.items()) for x in (lang, min(1.0, (2 * share + 50) / n))])
    place = F.pmod("h", F.lit(1 << 30))
    order = Window.partitionBy("lang").orderBy("place", "h")
    few = texts.withColumn("place", place).where(F.col("place") <= F.element_at(near, F.col("lang")) * (1 << 30))
    ranked = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= share)
    chosen = {(r["lang"], r["h"]): r["rank"] for r in ranked.select("lang", "h", "rank").collect()}  # at most ``sample``
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, given = shared.value, set()
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for some in slices(batch, 0):
                rows = []
                for text, lang, h in zip(*(some.column(i).to_pylist() for i in range(3))):
                    if not has_letter(text):
                        continue
                    tf = counts(text)
                    df += tf > 0
                    n += 1
                    if (lang, h) in wanted and (lang, h) not in given:  # once per task
                        given.add((lang, h))
                        rows.append({
                            "lang": lang, "rank": wanted[lang, h], "bucket": None, "n": None,
                            "tf": tf.astype("<u4").tobytes(), "pieces": pieces(text, h % (1 << 30)),
                        })
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=measured)
        rows = [{"lang": None, "rank": None, "bucket": int(b), "n": int(df[b]), "tf": None, "pieces": None} for b in np.flatnonzero(df)]
        rows.append({"lang": None, "rank": None, "bucket": BUCKETS, "n": n, "tf": None, "pieces": None})
        yield pa.RecordBatch.from_pylist(rows, schema=measured)

    measured = pa.schema([
        ("lang", pa.string()), ("rank", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("tf", pa.binary()),
        ("pieces", pa.list_(pa.string())),
    ])
    seen = known.select("text", "lang", F.xxhash64("text").alias("h"))
    seen = stage(seen.mapInArrow(tidy(measure), "lang string, rank int, bucket int, n long, tf binary, pieces array<string>"), "language")
    shared.unpersist()
    df = dict(seen.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n")).collect())
    total = df.pop(BUCKETS)
    idf = np.log((1 + total) / (1 + np.array([df.get(b, 0) for b in range(BUCKETS)]))).astype(np.float32) + 1
    first = seen.where("tf IS NOT NULL").groupBy("lang", "rank").agg(F.min("tf").alias("tf"), F.min("pieces").alias("pieces"))
    samples: dict[str, list[np.ndarray]] = {}
    parts: dict[str, list[list[str]]] = {}
    for r in sorted(first.collect(), key=lambda r: (r["lang"], r["rank"])):  # at most ``sample`` rows
        samples.setdefault(r["lang"], []).append(np.frombuffer(r["tf"], "<u4"))
        parts.setdefault(r["lang"], []).append(r["pieces"])
    model = Model(idf, np.zeros((0, BUCKETS), np.float32), [], np.zeros((0, 1 + len(LENGTHS))))
    if not samples:
        return none
    centroids, cosines = [], {}
    for lang, tfs in samples.items():
        own = spherical_kmeans(model.vectors(np.stack(tfs)), clusters)
        centroids.append(own)
        model.languages += [lang] * len(own)
        cosines[lang] = [[] for _ in LENGTHS]
        for k in range(len(LENGTHS)):
            some = [p[k] for p in parts[lang] if len(p) > k and has_letter(p[k])]
            if some:
                cosines[lang][k] = (model.vectors(np.stack([counts(t) for t in some])) @ own.T).max(axis=1).tolist()
    least = floors(cosines, reach)
    model.centroids = np.concatenate(centroids).astype(np.float32)
    model.limits = 1 - np.stack([least[lang] for lang in model.languages])
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """The input's columns and ``out_col``: (lang_pred, score, rejected)."""
    kept = docs.drop(out_col)
    at = kept.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few vectors per language
    fields = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for some in slices(batch, at):
                found = model.predict(some.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(found, fields)], names=[*some.schema.names, out_col]
                )

    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, RESULT)])
    return kept.mapInArrow(tidy(predict), schema)


@query("op6_language")
def op6_language(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted language of every document."""
    docs = documents(spark, sf)
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", _held_out("doc_id").alias("held_out"), "language.lang_pred", "language.score", "language.rejected"
    )
