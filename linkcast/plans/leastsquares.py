"""Least squares with many targets at once, from one pass over the rows.

A window with a sequence target asks for one model per step of the target. All of them, for
any number of ridge values, follow from the second moments of inputs and targets, which are
sums over rows: every task adds up the outer products of its rows, the sums of all tasks meet
in a shuffle by entry, and what reaches the driver does not grow with the rows. Errors on any
part of the rows follow from the moments of that part, so nothing has to be scored to compare
steps or to choose the ridge value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 4096  # rows that a task multiplies at once
MOST_COLUMNS = 4096


@dataclass
class Moments:
    """Sums over the rows of one group: their number, the sums and the products of all columns.

    Columns are the inputs, then the targets, less ``shift``, which keeps the products small.
    """

    n: int
    sums: np.ndarray
    products: np.ndarray
    shift: np.ndarray
    inputs: int

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.n + other.n, self.sums + other.sums, self.products + other.products, self.shift, self.inputs)

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """(means, products about the means)."""
        mean = self.sums / max(1, self.n)
        return mean + self.shift, self.products - self.n * np.outer(mean, mean)


def _widths(rows: DataFrame, x: str, y: str) -> tuple[int, int] | None:
    first = rows.select(F.size(x), F.size(y)).first()
    return None if first is None else (first[0], first[1])


def moments(rows: DataFrame, by: Sequence[str], x: str = "X", y: str = "y") -> dict[tuple, Moments]:
    """Moments of the arrays ``x`` and ``y`` (of one length each, without nulls) per group of ``by``.

    Groups are few (series and split): their number times the squared number of columns reaches
    the driver. An empty table gives an empty dictionary.
    """
    widths = _widths(rows, x, y)
    if widths is None:
        return {}
    p, q = widths
    size = p + q
    if size > MOST_COLUMNS:
        raise ValueError(f"{size} columns; at most {MOST_COLUMNS} fit the driver as a square")
    # A rough centre, the mean of each column over some rows, keeps the products from cancelling.
    some = rows.select(x, y).limit(10_000).select(F.posexplode(F.concat(x, y))).groupBy("pos").agg(F.avg("col").alias("m"))
    shift = np.zeros(size)
    for r in some.collect():
        shift[r["pos"]] = r["m"]
    upper = np.triu_indices(size)
    cells = len(upper[0])
    keyed = rows.select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("key"), F.concat(x, y).alias("v"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - shift
                names = np.array(part.column(0).to_pylist())
                for key in set(names.tolist()):
                    mine = values[names == key]
                    n, sums, products = total.get(key, (0, 0.0, 0.0))
                    total[key] = n + len(mine), sums + mine.sum(axis=0), products + mine.T @ mine
        for key, (n, sums, products) in total.items():
            entries = np.concatenate([[n], sums, products[upper]])
            for at in range(0, len(entries), 65_536):
                few = entries[at: at + 65_536]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(few)), pa.array(np.arange(at, at + len(few))), pa.array(few)], names=["key", "at", "v"]
                )

    found = keyed.mapInArrow(add_up, "key string, at long, v double").groupBy("key", "at").agg(F.sum("v").alias("v"))
    labels = {r["key"]: tuple(r[c] for c in by) for r in rows.select(*by).distinct().select("*", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("key")).collect()}
    flat: dict[str, np.ndarray] = {}
    for r in found.collect():
        flat.setdefault(r["key"], np.zeros(1 + size + cells))[r["at"]] = r["v"]
    out = {}
    for key, entries in flat.items():
        products = np.zeros((size, size))
        products[upper] = entries[1 + size:]
        products += np.triu(products, 1).T
        out[labels[key]] = Moments(int(entries[0]), entries[1: 1 + size], products, shift, p)
    return out


@dataclass
class Solution:
    """``y`` is about ``intercept + x @ weights``, one column per step."""

    weights: np.ndarray
    intercept: np.ndarray
    ridge: float

    def squared_errors(self, part: Moments) -> np.ndarray:
        """Sum of the squared errors per step over the rows of ``part``."""
        mean, about = part.centred()
        p = part.inputs
        w = self.weights
        bias = mean[p:] - self.intercept - mean[:p] @ w
        spread = np.diag(about[p:, p:]) - 2 * (w * about[:p, p:]).sum(axis=0) + (w * (about[:p, :p] @ w)).sum(axis=0)
        return np.maximum(spread, 0) + part.n * bias**2


def solve(train: Moments, ridges: Sequence[float] = (0.0,)) -> list[Solution]:
    """One solution per ridge value, all from one factorisation; inputs that depend on others share their weight.

    The penalty is ``ridge`` times the number of rows times the squared weights, not the intercept.
    """
    mean, about = train.centred()
    p = train.inputs
    values, axes = np.linalg.eigh(about[:p, :p])
    turned = axes.T @ about[:p, p:]
    full = values > max(values[-1] if p else 0.0, 0.0) * p * np.finfo(float).eps * 8
    out = []
    for ridge in ridges:
        scale = np.where(full, 1 / np.where(full, values + ridge * train.n, 1), 0.0)
        w = axes @ (scale[:, None] * turned)
        out.append(Solution(w, mean[p:] - mean[:p] @ w, ridge))
    return out


def predict(rows: DataFrame, solution: Solution, x: str = "X", out: str = "prediction") -> DataFrame:
    """The input's columns and the predicted sequence; a column of that name is replaced."""
    kept = rows.drop(out)
    at = kept.columns.index(x)
    shared = rows.sparkSession.sparkContext.broadcast(solution)  # inputs times steps

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        p, q = model.weights.shape
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                values = part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                found = pa.array((values @ model.weights + model.intercept).reshape(-1))
                offsets = pa.array(np.arange(0, len(found) + 1, q, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(offsets, found)], names=[*part.schema.names, out]
                )

    return kept.mapInArrow(score, T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


STEP_SCHEMA = "split string, step int, rmse double, r2 double, n long, ridge double"


def sequence_errors(
    windows: DataFrame, key: str, scales: DataFrame, ridges: Sequence[float] = (0.0,), x: str = "X", y: str = "y"
) -> tuple[Solution | None, DataFrame]:
    """Fit on the training windows, choose the ridge value on the validation ones, judge every step.

    ``windows`` are normalised per series, ``scales`` has (key, scale): errors are in the signal's units.
    Without training windows there is no solution and no row; without validation windows the first
    ridge value is taken.
    """
    spark = windows.sparkSession
    parts = moments(windows, [key, "split"], x, y)
    of = lambda split: {k: m for (k, s), m in parts.items() if s == split}
    train = list(of("train").values())
    if not train:
        return None, spark.createDataFrame([], STEP_SCHEMA)
    whole = train[0]
    for m in train[1:]:
        whole = whole + m
    scale = {r[key]: r["scale"] for r in scales.select(key, "scale").collect()}  # one number per series
    found = solve(whole, ridges)

    def error(solution: Solution, split: str) -> np.ndarray:
        return sum(scale[k] ** 2 * solution.squared_errors(m) for k, m in of(split).items())

    best = min(found, key=lambda s: float(np.sum(error(s, "val")))) if of("val") else found[0]
    rows = []
    for split in ("train", "val", "test"):
        mine = of(split)
        n = sum(m.n for m in mine.values())
        if not n:
            continue
        squares = error(best, split)
        # Spread of the targets in signal units about their common mean.
        p = whole.inputs
        spread, total = 0.0, 0.0
        for k, m in mine.items():
            mean, about = m.centred()
            spread = spread + scale[k] ** 2 * np.diag(about[p:, p:])
            total = total + m.n * scale[k] * mean[p:]
        for k, m in mine.items():
            mean, _ = m.centred()
            spread = spread + m.n * (scale[k] * mean[p:] - total / n) ** 2
        for step, (e, v) in enumerate(zip(squares, spread), 1):
            rows.append((split, step, float(np.sqrt(e / n)), float(1 - e / v) if v > 0 else None, n, best.ridge))
    return best, spark.createDataFrame(rows, STEP_SCHEMA)
