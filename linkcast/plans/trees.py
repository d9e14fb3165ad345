"""Regression trees grown level by level from histograms of binned rows, as MLlib models.

The rules are MLlib's: at most 32 bins per feature between thresholds from 10,000 rows, the
split with the largest loss of variance (the first of equals), MLlib's limits on nodes, and
twice the residual as the target of a boosted tree. Rows are held as one byte per feature in
blocks. Few rows are grown in the driver; more stay with the executors, which send sums of
groups of nodes. A pass holds at most ``HISTOGRAM_MB`` of sums per task, whatever the rows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcast.session import stage, stage_root

BINS = 32
SPLIT_ROWS = 10_000  # rows that thresholds are read from, as MLlib does
LOCAL_ROWS = 50_000  # so many rows are grown in the driver
HISTOGRAM_MB = 48
CHUNK = 16  # nodes whose sums travel together
EPSILON = 2.0**-52  # variance of a node that is not split
CHECKPOINT = 20  # boosted trees between two written states
# Poisson counts of mean 1 by 16 random bits.
_POISSON = np.searchsorted(
    np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(65_536) + 0.5) / 65_536
).astype(np.uint8)


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1 and is its own child, so that walks may go on."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])  # bins up to this one go left
    kids: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])
    sums: list[tuple[float, float, float | None]] = field(default_factory=lambda: [(0.0, 0.0, None)])  # rows, y, y * y
    gain: list[float] = field(default_factory=lambda: [-1.0])

    def arrays(self):
        return (
            np.maximum(np.array(self.feature), 0), np.array(self.cut), np.array(self.kids).ravel(),
            np.array([s / n if n else 0.0 for n, s, _ in self.sums]),
        )

    def split(self, node: int, feature: int, cut: int, gain: float, left, right) -> tuple[int, int]:
        kids = len(self.feature), len(self.feature) + 1
        for k, sums in zip(kids, (left, right)):
            self.feature.append(-1)
            self.cut.append(0)
            self.kids.append((k, k))
            self.sums.append(sums)
            self.gain.append(-1.0)
        self.feature[node], self.cut[node], self.kids[node], self.gain[node] = feature, cut, kids, gain
        return kids

    def pruned(self) -> "Tree":
        """Without splits whose two leaves predict the same."""
        gone = set()
        for node in reversed(range(len(self.feature))):
            a, b = self.kids[node]
            if self.feature[node] >= 0 and self.feature[a] < 0 and self.feature[b] < 0:
                (n, s, _), (m, t, _) = self.sums[a], self.sums[b]
                if s / n == t / m:
                    self.feature[node], self.kids[node], self.gain[node] = -1, (node, node), -1.0
                    gone |= {a, b}
        keep = [i for i in range(len(self.feature)) if i not in gone]
        at = {i: k for k, i in enumerate(keep)}
        pick = lambda values: [values[i] for i in keep]
        kids = [(at[a], at[b]) for a, b in pick(self.kids)]
        return Tree(pick(self.feature), pick(self.cut), kids, pick(self.sums), pick(self.gain))


@dataclass
class Ensemble:
    """Trees with their thresholds and weights, for scoring without a JVM object per node."""

    thresholds: list[np.ndarray]
    trees: list[Tree]
    weights: list[float]
    mean: bool  # a forest's average; else a weighted sum

    def first(self, n: int) -> "Ensemble":
        return Ensemble(self.thresholds, self.trees[:n], self.weights[:n], self.mean)

    def walks(self):
        """Arrays per tree: features, thresholds, children, values."""
        out = []
        for tree in self.trees:
            feature, cut, kids, value = tree.arrays()
            at = [self.thresholds[f][c] if g >= 0 else 0.0 for f, c, g in zip(feature, cut, tree.feature)]
            out.append((feature, np.array(at), kids, value, _depth(tree)))
        return out


def _depth(tree: Tree) -> int:
    depth = [0] * len(tree.feature)
    for node, kids in enumerate(tree.kids):
        for k in kids:
            if k != node:
                depth[k] = depth[node] + 1
    return max(depth)


def _walk(flat, row, step, feature, limit, kids, depth):
    """The leaf of every row; ``flat[row + feature * step]`` is a row's value of a feature."""
    node = np.zeros(len(row), np.int64)
    for _ in range(depth):
        node = kids[2 * node + (flat[row + feature[node] * step] > limit[node])]
    return node


def thresholds(df: DataFrame, n: int, features: Sequence[str], seed: int) -> list[np.ndarray]:
    """Split candidates per feature: all midpoints of few values, else equal shares of the rows."""
    sample = df.select(*features)
    if n > max(BINS * BINS, SPLIT_ROWS):
        sample = sample.sample(False, SPLIT_ROWS / n, seed)
    table = sample.toArrow()
    return [_cuts(table.column(i).to_numpy()) for i in range(len(features))]


def _cuts(values: np.ndarray) -> np.ndarray:
    x, counts = np.unique(values, return_counts=True)
    mids = (x[:-1] + x[1:]) / 2.0
    if len(x) <= BINS:
        return mids
    stride, out, done = len(values) / BINS, [], np.cumsum(counts)
    target = stride
    for i in range(1, len(x)):
        if abs(done[i - 1] - target) < abs(done[i] - target):
            out.append(mids[i - 1])
            target += stride
    return np.array(out)


def _block(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(t, x, "left") for t, x in zip(cuts, columns)]).astype(np.uint8)


class Rows:
    """Binned training rows: a list in the driver, or partitions on the executors."""

    def __init__(self, df: DataFrame, features: Sequence[str], seed: int, local_rows: int | None = None):
        self.spark, self.n = df.sparkSession, df.count()
        self.cuts = cuts = thresholds(df, self.n, features, seed)
        df, width = df.select(*features, "y"), len(features)
        if self.n <= (LOCAL_ROWS if local_rows is None else local_rows):
            columns = [c.to_numpy() for c in df.repartition(1).toArrow().columns]
            self.rdd, self.blocks = None, [(0, _block(columns[:-1], cuts), columns[-1])]
            return

        def binned(batches):
            part = TaskContext.get().partitionId()
            for i, b in enumerate(batches):
                if b.num_rows:
                    columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                    found = _block(columns[:-1], cuts).tobytes(), columns[-1].tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([(part << 32) + i]), pa.array([found[0]], pa.binary()), pa.array([found[1]], pa.binary())],
                        ["block", "bins", "y"],
                    )

        kept = stage(df.mapInArrow(binned, "block long, bins binary, y binary"), "bins")
        cores = self.spark.sparkContext.defaultParallelism
        if kept.rdd.getNumPartitions() != cores:
            kept = kept.repartition(cores, "block")

        def block(row):
            y = np.frombuffer(row.y)
            return row.block, np.frombuffer(row.bins, np.uint8).reshape(width, len(y)), y

        self.blocks, self.rdd = None, _single(kept.rdd.map(block)).persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        if self.rdd is not None:
            self.rdd.unpersist()


def _single(rdd):
    """One element per batch, so that ``zip`` pairs the pieces as they lie."""
    from pyspark.serializers import BatchedSerializer, CPickleSerializer

    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _tally(blocks, walks, slots: int, width: int, weigh, squares: bool = False):
    """Rows and sums of y per node, feature and bin, and sums of y * y per node; by feature and bin too with ``squares``."""
    hist = np.zeros((width, slots * BINS), np.complex128)
    square = np.zeros((width, slots * BINS) if squares else slots)
    for block, bins, y in blocks:
        n, flat = len(y), bins.ravel()
        for tree, (feature, cut, kids, depth, slot) in walks.items():
            w = weigh(tree, block, n)
            row = np.arange(n) if w is None else np.flatnonzero(w)
            at = slot[_walk(flat, row, n, feature, cut, kids, depth)]
            if (at < 0).any():
                row, at = row[at >= 0], at[at >= 0]
            if not len(row):
                continue
            z = (1 if w is None else w[row]) * (1 + 1j * y[row])
            every = len(row) == n
            z2 = z.imag * y[row]
            if not squares:
                square += np.bincount(at, z2, slots)
            at = at * BINS
            for f in range(width):
                cell = at + (bins[f] if every else bins[f][row])
                np.add.at(hist[f], cell, z)
                if squares:
                    np.add.at(square[f], cell, z2)
    by_node = lambda x: x.reshape(width, slots, BINS).transpose(1, 0, 2)
    return by_node(hist), by_node(square) if squares else square


def _variance(n, s, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (q - s * s / n) / n)


def _usable(left, right, cuts, least, allowed):
    usable = np.arange(BINS - 1) < np.array([len(c) for c in cuts])[:, None]
    usable = usable & (left.real >= least) & (right.real >= least)
    return usable if allowed is None else usable & allowed[:, :, None]


def _best(hist: np.ndarray, square: np.ndarray, cuts, least: int, allowed):
    """Per node: its sums, and gain, feature, bin and the sums of both sides of the best split."""
    left = hist.cumsum(2)
    total = left[:, :1, -1:]
    left = left[:, :, :-1]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left.imag**2 / left.real + right.imag**2 / right.real - total.imag**2 / total.real
    gain = np.where(_usable(left, right, cuts, least, allowed), gain, -1.0).reshape(len(hist), -1)
    out = []
    for i, k in enumerate(gain.argmax(1)):
        n, s, q = total[i, 0, 0].real, total[i, 0, 0].imag, square[i]
        f, cut = divmod(int(k), BINS - 1)
        # A node of one value has nothing to gain but rounding.
        pure = not n or q / n - (s / n) ** 2 <= np.finfo(float).eps * max(1.0, q / n)
        sides = [(float(x.real), float(x.imag), None) for x in (left[i, f, cut], right[i, f, cut])]
        out.append(((float(n), float(s), float(q)), -1.0 if pure else float(gain[i, k] / n), f, cut, *sides))
    return out


def _best_as_mllib(hist: np.ndarray, square: np.ndarray, cuts, least: int, allowed, known):
    """The same with MLlib's order of operations: equal gains differ by rounding only, and fall as they do there.

    ``known`` are the sums that the split above gave to a node.
    """
    left, left2 = hist.cumsum(2), square.cumsum(2)
    total, total2 = left[:, :, -1:], left2[:, :, -1:]
    left, left2 = left[:, :, :-1], left2[:, :, :-1]
    right, right2 = total - left, total2 - left2
    low, high = _variance(left.real, left.imag, left2), _variance(right.real, right.imag, right2)
    # The root has the sums of its first split.
    top = [x or tuple(map(float, (z.real, z.imag, q))) for x, z, q in zip(
        known, left[:, 0, 0] + right[:, 0, 0], left2[:, 0, 0] + right2[:, 0, 0])]
    own = _variance(*np.array(top).T)
    n = left.real + right.real
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = own[:, None, None] - left.real / n * low - right.real / n * high
    gain = np.where(_usable(left, right, cuts, least, allowed), gain, -1.0).reshape(len(hist), -1)
    at, k = np.arange(len(hist)), gain.argmax(1)
    f, cut = np.divmod(k, BINS - 1)
    sides = [
        zip(x.real.tolist(), x.imag.tolist(), q.tolist())
        for x, q in ((left[at, f, cut], left2[at, f, cut]), (right[at, f, cut], right2[at, f, cut]))
    ]
    return list(zip(top, gain[at, k].tolist(), f.tolist(), cut.tolist(), *sides))


def _allowed(nodes, width: int, share: float, seed: int):
    """The features a node may use, drawn by tree and node."""
    if share >= 1.0:
        return None
    out = np.zeros((len(nodes), width), bool)
    for row, (tree, node) in zip(out, nodes):
        row[np.random.default_rng([seed, tree, node]).permutation(width)[: math.ceil(share * width)]] = True
    return out


def grow(rows: Rows, source, trees: dict[int, Tree], depth: int, least: int, share: float, seed: int, weigh) -> None:
    """Grow trees to ``depth``; ``source`` gives blocks (a list or RDD) with the target in place of y."""
    width = len(rows.cuts)
    cuts, room = rows.cuts, max(CHUNK, int(HISTOGRAM_MB * 1e6 / (width * BINS * 16)))
    frontier, above, parent = [(t, 0) for t in trees], {}, {}
    for level in range(depth):
        following = []
        few = rows.rdd is not None and len(frontier) <= 2 * CHUNK
        above = above if few else {}
        for start in range(0, len(frontier), room):
            group = frontier[start : start + room]
            allowed = _allowed(group, width, share, seed)
            if few:
                above = _sums_of_few(source, trees, group, level, above, parent, width, weigh)
                hist, square = (np.stack(x) for x in zip(*(above[x] for x in group)))
                found = _best(hist, square, cuts, least, allowed)
            elif rows.rdd is not None:
                found = _spread(source, _walks(trees, group, level), group, cuts, least, share, seed, weigh)
            else:
                hist, square = _tally(source, _walks(trees, group, level), len(group), width, weigh, True)
                known = [trees[t].sums[node] if node else None for t, node in group]
                found = _best_as_mllib(hist, square, cuts, least, allowed, known)
            for (t, node), (sums, gain, f, cut, left, right) in zip(group, found):
                trees[t].sums[node] = sums
                if gain > 0:
                    for k, side in zip(trees[t].split(node, f, cut, gain, left, right), (left, right)):
                        parent[t, k] = t, node
                        n, s, q = side
                        if q is None or abs((q - s * s / n) / n) >= EPSILON:
                            following.append((t, k))
        frontier = following


def _walks(trees, group, level: int) -> dict:
    """What a task needs to find the rows of a group of nodes."""
    slots = {}
    for i, (t, node) in enumerate(group):
        slots.setdefault(t, {})[node] = i
    walks = {}
    for t, own in slots.items():
        feature, cut, kids, _ = trees[t].arrays()
        slot = np.full(len(feature), -1)
        slot[list(own)] = list(own.values())
        walks[t] = feature, cut, kids, level, slot
    return walks


def _sums_of_few(source, trees, group, level: int, above, parent, width: int, weigh) -> dict:
    """Sums of a few nodes in the driver; the larger of two children is its parent less the smaller."""
    pairs = [group] if not above else [group[i : i + 2] for i in range(0, len(group), 2)]
    size = lambda x: trees[x[0]].sums[x[1]][0]
    counted = [x for pair in pairs for x in (pair if not above else [min(pair, key=size)])]
    walks = _walks(trees, counted, level)

    def sums(blocks):
        yield _tally(blocks, walks, len(counted), width, weigh)

    add = lambda a, b: (a[0] + b[0], a[1] + b[1])
    parts = source.mapPartitions(sums)
    hist, square = parts.treeReduce(add) if parts.getNumPartitions() > 64 else reduce(add, parts.collect())
    out = {x: (hist[i], square[i]) for i, x in enumerate(counted)}
    for x in group:
        if x not in out:
            (small,) = (y for y in counted if parent[y] == parent[x])
            out[x] = tuple(p - q for p, q in zip(above[parent[x]], out[small]))
    return out


def _spread(source, walks, group, cuts, least, share, seed, weigh):
    """The best splits of a group of nodes, each found where the sums of its chunk meet."""
    width = len(cuts)

    def sums(blocks):
        hist, square = _tally(blocks, walks, len(group), width, weigh)
        for k in range(0, len(group), CHUNK):
            yield k, (np.ascontiguousarray(hist[k : k + CHUNK]), square[k : k + CHUNK])

    def best(item):
        k, (hist, square) = item
        return k, _best(hist, square, cuts, least, _allowed(group[k : k + CHUNK], width, share, seed))

    parts = source.mapPartitions(sums)
    met = parts.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), min(parts.getNumPartitions(), -(-len(group) // CHUNK)))
    return [x for _, some in sorted(met.map(best).collect()) for x in some]


def forest(df: DataFrame, features: Sequence[str], trees: int, depth: int, seed: int, **rows) -> Ensemble:
    """Bagged trees. In the driver the draws are those of MLlib's single partition."""
    source = Rows(df, features, seed, **rows)
    weigh = _mllib_bags(source, trees, seed) if source.rdd is None else _bags(seed)
    grown = {t: Tree() for t in range(trees)}
    try:
        grow(source, source.blocks if source.rdd is None else source.rdd, grown, depth, 1, 1.0, seed, weigh)
    finally:
        source.close()
    return Ensemble(source.cuts, [t.pruned() for t in grown.values()], [1.0] * trees, True)


def _bags(seed: int):
    def weigh(tree, block, n):
        return _POISSON[np.random.Generator(np.random.SFC64([seed, tree, block])).integers(0, 65_536, n, np.uint16)]

    return weigh


def _mllib_bags(rows: Rows, trees: int, seed: int):
    jvm = rows.spark.sparkContext._jvm
    draw = jvm.org.apache.commons.math3.distribution.PoissonDistribution(1.0)
    draw.reseedRandomGenerator(seed + 1)
    text = jvm.java.util.Arrays.toString(draw.sample(rows.n * trees))[1:-1] if rows.n else ""
    counts = np.array(text.split(","), np.uint8).reshape(rows.n, trees).T
    return lambda tree, block, n: counts[tree]


def _share_of_rows(rate: float, seed: int):
    if rate >= 1.0:
        return lambda tree, block, n: None
    return lambda tree, block, n: (np.random.default_rng([seed, tree, block]).random(n) < rate).astype(np.uint8)


def boost(
    df: DataFrame, features: Sequence[str], trees: int, depth: int, rate: float, seed: int, least: int = 1,
    subsample: float = 1.0, share: float = 1.0, stop=None, **rows,
) -> Ensemble:
    """Boosted trees; ``stop(ensemble)`` is asked after every 50 whether more are of use."""
    source = Rows(df, features, seed, **rows)
    weigh, out = _share_of_rows(subsample, seed), Ensemble(source.cuts, [], [], False)
    local = source.rdd is None
    state = [np.zeros(len(y)) for _, _, y in source.blocks] if local else _single(source.rdd.map(lambda b: np.zeros(len(b[2]))))
    held = []
    try:
        for m in range(trees):
            first = not m

            def target(pair, first=first):
                (block, bins, y), done = pair
                return block, bins, y if first else 2.0 * (y - done)

            rest = [target(p) for p in zip(source.blocks, state)] if local else source.rdd.zip(state).map(target)
            tree = Tree()
            grow(source, rest, {m: tree}, depth, least, share, seed, weigh)
            out.trees.append(tree.pruned())
            out.weights.append(1.0 if first else rate)
            if m + 1 == trees or (stop and not (m + 1) % 50 and stop(out)):
                break
            walk, weight = (*out.trees[-1].arrays(), _depth(out.trees[-1])), out.weights[-1]

            def add(pair, walk=walk, weight=weight):
                (_, bins, y), done = pair
                feature, cut, kids, value, deep = walk
                return done + weight * value[_walk(bins.ravel(), np.arange(len(y)), len(y), feature, cut, kids, deep)]

            if local:
                state = [add(p) for p in zip(source.blocks, state)]
                continue
            state = _single(source.rdd.zip(state).map(add)).persist(StorageLevel.MEMORY_AND_DISK)
            if not len(out.trees) % CHECKPOINT:
                _checkpoint(state, source.spark)
            held.append(state)
            if len(held) > 2:
                held.pop(0).unpersist()
    finally:
        for x in held:
            x.unpersist()
        source.close()
    return out


def _checkpoint(rdd, spark: SparkSession) -> None:
    """Written where all executors read, so that the way back to a lost piece stays short."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(stage_root(spark))
    rdd.checkpoint()


def predictions(ensemble: Ensemble, features: Sequence[str]) -> Column:
    """The prediction of a row as a column."""
    walks, weights, mean = ensemble.walks(), ensemble.weights, ensemble.mean

    def predict(batches: Iterator):
        for x in batches:
            values, row = np.ascontiguousarray(x.to_numpy()), np.arange(len(x)) * x.shape[1]
            total = np.zeros(len(x))
            for (feature, at, kids, value, depth), w in zip(walks, weights):
                total += w * value[_walk(values.ravel(), row, 1, feature, at, kids, depth)]
            yield _series(total / len(walks) if mean else total)

    import pandas as pd

    predict.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return F.pandas_udf(predict, "double")(F.struct(*features))


def _series(values):
    import pandas as pd

    return pd.Series(values)


def errors_by_tree(ensemble: Ensemble, df: DataFrame, features: Sequence[str]) -> list[float]:
    """Mean squared error after each tree; nothing without rows."""
    walks, weights = ensemble.walks(), ensemble.weights

    def errors(batches):
        total, n = np.zeros(len(walks)), 0
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not b.num_rows:
                continue
            values, row, e = np.stack(columns[:-1]).ravel(), np.arange(b.num_rows), columns[-1].copy()
            n += b.num_rows
            for i, ((feature, at, kids, value, depth), w) in enumerate(zip(walks, weights)):
                e -= w * value[_walk(values, row, b.num_rows, feature, at, kids, depth)]
                total[i] += e @ e
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([n])], ["e", "n"])

    found = df.select(*features, "y").mapInArrow(errors, "e array<double>, n long").collect()
    n = sum(r.n for r in found)
    return [float(x) / n for x in np.sum([r.e for r in found if r.n], axis=0)] if n else []


def to_mllib(ensemble: Ensemble, estimator, spark: SparkSession):
    """The same trees as an MLlib model, through MLlib's file format."""
    kind = RandomForestRegressionModel if ensemble.mean else GBTRegressionModel
    base, n = f"{stage_root(spark)}/linkcast-trees-{uuid.uuid4().hex}", len(ensemble.thresholds)
    about = lambda name, uid, params: {
        "class": f"org.apache.spark.ml.regression.{name}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid,
        "paramMap": params, "defaultParamMap": {"impurity": "variance"},
    }
    params = {p.name: v for p, v in estimator.extractParamMap().items() if estimator.isSet(p)}
    own = {k: v for k, v in params.items() if k in ("labelCol", "maxDepth", "seed")}
    parts, heads = [], []
    for t, (tree, weight) in enumerate(zip(ensemble.trees, ensemble.weights)):
        heads.append((t, json.dumps(about("DecisionTreeRegressionModel", f"{estimator.uid}_{t}", own)), weight))
        parts.append(_nodes(t, tree, ensemble.thresholds))
    spark.createDataFrame(pa.concat_tables(parts)).coalesce(1).write.parquet(f"{base}/data")
    spark.createDataFrame(heads, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{base}/treesMetadata")
    head = about(kind.__name__, estimator.uid, params) | {"numFeatures": n, "numTrees": len(heads)}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{base}/metadata")
    return kind.load(base)


def _nodes(number: int, tree: Tree, thresholds) -> pa.Table:
    """A tree in the columns of MLlib's files."""
    size, leaf = len(tree.feature), np.array(tree.feature) < 0
    sums = np.array([(n, s, 0.0 if q is None else q) for n, s, q in tree.sums])
    n, s, q = sums.T
    unknown = np.array([x is None for *_, x in tree.sums])
    kids = np.where(leaf[:, None], -1, np.array(tree.kids)).astype(np.int32)
    at = [[] if f < 0 else [float(thresholds[f][c])] for f, c in zip(tree.feature, tree.cut)]
    split = {
        "featureIndex": pa.array(tree.feature, pa.int32()),
        "leftCategoriesOrThreshold": pa.array(at, pa.list_(pa.float64())),
        "numCategories": pa.array(np.full(size, -1, np.int32)),
    }
    node = {
        "id": pa.array(np.arange(size, dtype=np.int32)),
        "prediction": pa.array(tree.arrays()[3]),
        "impurity": pa.array(np.where(unknown, -1.0, _variance(n, s, q))),
        "impurityStats": pa.array(sums.tolist(), pa.list_(pa.float64())),
        "rawCount": pa.array(n.astype(np.int64)),
        "gain": pa.array(tree.gain, pa.float64()),
        "leftChild": pa.array(kids[:, 0]),
        "rightChild": pa.array(kids[:, 1]),
        "split": pa.StructArray.from_arrays(list(split.values()), list(split)),
    }
    struct = pa.StructArray.from_arrays(list(node.values()), list(node))
    return pa.table({"treeID": pa.array(np.full(size, number, np.int32)), "nodeData": struct})
