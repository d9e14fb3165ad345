"""PCA whitening of embeddings by shifted Cholesky QR over distributed Gram matrices.

Entries become whole numbers x = floor(scale * entry) + offset, so that their sums S and the
centred rows (n * x - S) are exact, whatever the offset. With A the centred rows over n:

1. A Gram pass sums A'A over all partitions. Its Cholesky factor R1, of A'A plus a small
   multiple of the identity, exists however badly A is conditioned.
2. Further passes form the Gram matrix of Q = A R1^-1 R2^-1 ... by triangular solves on the rows
   of each partition, and its factor joins the product R = ... R2 R1. After two or three passes Q
   has orthonormal columns to machine precision, so that A = Q R without the square of the
   condition number that a covariance matrix would have.
3. The singular values of R are those of A. Its right singular vectors are the components, in
   falling order, and their eigenvalues the squares over n. Where columns of A depend on each
   other Q has empty directions; the square root of the last Gram matrix takes them out.

Only vectors and matrices of the dimension reach the driver, ``MOST_DIMENSIONS`` square at most.
Partial Gram matrices are added up by entry in a shuffle, so no task sees more than a share.

A row is dropped when its vector is null or empty, or holds a null or an entry that is not
finite; so are rows of another dimension than most (of equally frequent ones, the larger). Null
ids are kept as null, repeated rows count and come back as often as they are there, ties of
eigenvalues come in any order. Components without variance (constant or dependent columns) have
no whitened form and are left out. An empty table, or one of equal rows, gives no rows.
``deviation`` is null where the sum does not fit a long. Entries beyond ``MOST_ENTRY`` in size
raise an error, as their whole numbers do not fit. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcast.llm.common import query

SCALE, OFFSET = 64, 1_000_000
MOST_DIMENSIONS = 4096
MOST_ENTRY = 2.0**52
ROWS = 1024  # rows that a task turns into numbers at once
MOST_PASSES = 6
EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # exact, as Python integers
    components: np.ndarray  # one unit row per component, by falling eigenvalue
    eigenvalues: np.ndarray
    total: float  # trace of the covariance
    passes: int
    drift: float  # largest entry of the last Gram matrix minus the identity on the range of A


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, embedding as doubles) of the rows that count, and their dimension (0: none)."""
    v = F.col(vector_col).cast("array<double>")
    good = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = table.where(good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return rows.limit(0), 0
    d = sizes[0]["d"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; at most {MOST_DIMENSIONS} fit the driver as a square")
    return rows.where(F.size("embedding") == d), d


def whole(batch: pa.RecordBatch, column: int, d: int) -> Iterator[np.ndarray]:
    """Rows of whole numbers, ROWS at a time."""
    for at in range(0, batch.num_rows, ROWS):
        found = batch.column(column).slice(at, ROWS)
        entries = found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), d)
        if len(entries) and np.abs(entries).max() >= MOST_ENTRY / SCALE:
            raise ValueError(f"an entry is larger than {MOST_ENTRY / SCALE:.0f} in size")
        yield np.floor(SCALE * entries).astype(np.int64) + OFFSET


def summed(rows: DataFrame, size: int, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: str) -> np.ndarray:
    """Sum over all partitions of the numbers that ``part`` makes of one, each added up in a shuffle."""
    schema = pa.schema([("at", pa.int32()), ("v", pa.int64() if kind == "long" else pa.float64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = part(batches)
        if numbers is not None:
            for at in range(0, size, 65_536):
                some = numbers[at: at + 65_536]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.array(some, schema[1].type)], schema=schema
                )

    v = F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")
    found = rows.mapInArrow(partial, f"at int, v {kind}").groupBy("at").agg(F.sum(v).alias("v")).collect()
    out = np.zeros(size, object if kind == "long" else float)
    for r in found:
        out[r["at"]] = int(r["v"]) if kind == "long" else r["v"]
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n without rounding before the division: x lies near S // n."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([float(s % n) / n for s in sums])
    return (x - base) - rest


def _column_sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """The number of rows and the exact sum of every column."""

    def part(batches):
        total, n = np.zeros(2 * d, np.int64), 0
        for batch in batches:
            for x in whole(batch, 0, d):
                # Halves of 32 bits: neither sum can overflow.
                total[:d] += (x >> 32).sum(axis=0)
                total[d:] += (x & 0xFFFFFFFF).sum(axis=0)
                n += len(x)
        return np.append(total, n) if n else None

    found = summed(rows.select("embedding"), 2 * d + 1, part, "long")
    return int(found[-1]), found[:d] * (1 << 32) + found[d: 2 * d]


def _gram(rows: DataFrame, d: int, width: int, to_rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Gram matrix of what ``to_rows`` makes of the whole numbers."""
    upper = np.triu_indices(width)

    def part(batches):
        total = np.zeros((width, width))
        seen = False
        for batch in batches:
            for x in whole(batch, 0, d):
                q = to_rows(x)
                total += q.T @ q
                seen = True
        return total[upper] if seen else None

    out = np.zeros((width, width))
    out[upper] = summed(rows.select("embedding"), len(upper[0]), part, "double")
    return out + np.triu(out, 1).T


def solve_rows(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``a`` times the inverse of the upper triangle ``r``, column by column."""
    q = np.empty_like(a, order="F")
    for j in range(len(r)):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def shifted_cholesky(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper factor of the Gram matrix plus the smallest shift that lets it exist."""
    d = len(gram)
    scale = float(np.trace(gram)) or 1.0
    shift = 11 * (n * d + d * (d + 1)) * EPS / 2 * np.linalg.norm(gram, 2) if first else 0.0
    least = d * EPS * scale
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, least)


def fit(rows: DataFrame, d: int, most: int = 32) -> Whitening | None:
    """Components of all ``rows``; None where there is no variance."""
    if not d:
        return None
    n, sums = _column_sums(rows, d)
    if not n:
        return None
    r = np.eye(d)
    drift, passes = np.inf, 0
    spread = None
    while passes < MOST_PASSES:
        gram = _gram(rows, d, d, lambda x, r=r: solve_rows(centred(x, n, sums), r))
        if spread is None:
            spread = float(np.trace(gram))
            if spread == 0:
                return None
        values, axes = np.linalg.eigh(gram)
        full = values > values[-1] * d * EPS * 64
        drift, before = float(np.abs(values[full] - 1).max()), drift
        passes += 1
        if passes > 1 and (drift < 64 * d * EPS or drift > before / 2):
            break
        r = shifted_cholesky(gram, n, passes == 1) @ r
    root = (axes * np.sqrt(np.maximum(values, 0))) @ axes.T
    _, sigma, right = np.linalg.svd(root @ r)
    keep = (sigma > sigma[0] * d * EPS * 8)[: most]
    some = np.flatnonzero(keep)
    return Whitening(n, sums, right[some], sigma[some] ** 2 / n, spread / n, passes, drift)


def identity_error(rows: DataFrame, d: int, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity."""
    k = len(model.components)
    n, sums, axes, scale = model.n, model.sums, model.components, np.sqrt(model.eigenvalues)
    project = lambda x: centred(x, n, sums) @ axes.T / scale

    def part(batches):
        total, seen = np.zeros(k), False
        for batch in batches:
            for x in whole(batch, 0, d):
                total += project(x).sum(axis=0)
                seen = True
        return total if seen else None

    mean = summed(rows.select("embedding"), k, part, "double") / n
    cov = _gram(rows, d, k, lambda x: project(x) - mean) / n
    return float(np.abs(cov - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n * x - S) ** 2, exact; None beyond a long."""
    small = float(np.abs(centred(x, n, sums)).max(initial=0)) * n
    if small**2 * max(1, len(sums)) < 2.0**62 and all(abs(s) < 2**62 for s in sums) and int(np.abs(x).max(initial=0)) * n < 2**62:
        return ((x * n - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - sums) ** 2).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in exact]


WHITENED = "vec_id long, component int, deviation long, whitened double"


def whiten(rows: DataFrame, d: int, model: Whitening | None) -> DataFrame:
    """WHITENED: one row per vector and component."""
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64())])
    if model is None:
        return rows.sparkSession.createDataFrame([], WHITENED)
    k = len(model.components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.array(np.arange(1, k + 1, dtype=np.int32))
        for batch in batches:
            at = 0
            for x in whole(batch, 1, d):
                white = centred(x, model.n, model.sums) @ model.components.T / np.sqrt(model.eigenvalues)
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(x)).take(pa.array(each)), pa.concat_arrays([numbers] * len(x)),
                    pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)),
                    pa.array(white.reshape(-1)),
                ], schema=schema)
                at += len(x)

    return rows.select("vec_id", "embedding").mapInArrow(project, WHITENED)


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Whitened coordinates of every vector in up to 32 components."""
    rows, d = vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    model = fit(rows, d, 32)
    out = whiten(rows, d, model)
    share = [] if model is None else (model.eigenvalues / model.total).tolist()
    error = None if model is None else identity_error(rows, d, model)
    explained = F.lit(share).cast("array<double>")
    return out.select(
        "vec_id", "component", F.lit(None if model is None else model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
