"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut into full pieces and a rest. Full pieces are
sequences already. The rests are numbered and dealt in turn into cells of at most ``cell_items``;
every cell is a packing problem of its own, solved on ``islands`` islands:

* an individual is a grouping of the items into sequences; its fitness is the mean of the
  squared fill, so that full sequences count more than evenly filled ones;
* the first individuals come from best-fit over the items by size, and in mixed orders;
* crossover injects whole well-filled sequences of one parent into the other, removes the
  sequences that hold a duplicate, and best-fits the displaced items, largest first;
* after each epoch the best of an island moves on to the next island of its cell;
* a cell is done when its number of sequences meets the lower bound of its tokens.

Sequences that stay emptier than ``solid`` are then dissolved, and their items dealt into
fewer cells, until one cell is left. When a level would leave more than ``stall`` of its
items, they hardly fit together, and dealing them again would not end: all sequences of that
level stay. No task sees more than a cell, the driver sees counts.

A null text is an empty document, which is its end id alone. Null ids and repeated rows are
packed like all others. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcast.llm.common import documents, query, slices, tidy
from linkcast.llm.tokens import encoder, forget, vocabulary
from linkcast.session import stage

CAPACITY = 2048
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(
    docs: DataFrame, path: str, keeps_space: bool, end_id: int, capacity: int = CAPACITY,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; ``start`` counts the ids before it."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keeps_space)
        for batch in batches:
            for some in slices(batch, 1):
                out: list[list] = [[], [], [], [], []]
                for doc, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist())):
                    ids += end
                    for k in range(0, len(ids), 4 * capacity):
                        piece = ids[k: k + 4 * capacity]
                        row = (doc, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece))
                        for column, v in zip(out, row):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(cut), PIECE_SCHEMA)


def load(sizes: list[int], items: list[int]) -> int:
    return sum(map(sizes.__getitem__, items))


def best_fit(sizes: list[int], order, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Put the items of ``order`` one by one where the least room is left; opens new bins."""
    width = 1 << 24
    room = sorted((capacity - load(sizes, b)) * width + k for k, b in enumerate(bins))
    for item in order:
        size = sizes[item]
        at = bisect_left(room, size * width)
        if at < len(room):
            left, k = divmod(room.pop(at), width)
        else:
            left, k = capacity, len(bins)
            bins.append([])
        bins[k].append(item)
        insort(room, (left - size) * width + k)
    return bins


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones."""
    squares = sum(load(sizes, b) ** 2 for b in bins)
    return -len(bins), squares / capacity**2 / max(1, len(bins))


def cross(sizes, first, second, capacity: int, rng) -> list[list[int]]:
    """``first`` with well-filled bins of ``second`` injected."""
    fill = [load(sizes, b) for b in second]
    middle = sorted(fill)[len(fill) // 2]
    well = [k for k, f in enumerate(fill) if f >= middle]
    chosen = rng.choice(well, max(1, len(well) // 3), replace=False).tolist()
    injected = [list(second[k]) for k in chosen]
    inside = {i for b in injected for i in b}
    kept, displaced = injected, []
    for b in first:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(sizes, displaced, kept, capacity)


def mutate(sizes, bins, capacity: int, rng) -> list[list[int]]:
    """Dissolve the emptiest bin and a few others, and best-fit their items again."""
    gone = {min(range(len(bins)), key=lambda k: load(sizes, bins[k])), *rng.integers(0, len(bins), 3).tolist()}
    items = [i for k in gone for i in bins[k]]
    rng.shuffle(items)
    return best_fit(sizes, items, [list(b) for k, b in enumerate(bins) if k not in gone], capacity)


def evolve(lengths: np.ndarray, capacity: int, seed: int, elite: list[list[int]] | None, population: int,
           generations: int) -> list[list[int]]:
    """The best grouping an island finds."""
    sizes = lengths.tolist()
    least = -(-sum(sizes) // capacity)
    order = np.argsort(-lengths, kind="stable").tolist()
    groups = [best_fit(sizes, order, [], capacity)]
    if elite:
        groups.append(elite)
    rng = np.random.default_rng(seed)
    best = max(groups, key=lambda b: fitness(sizes, b, capacity))
    if len(best) <= least or len(sizes) < 3:
        return best
    while len(groups) < population:
        noise = lengths * rng.uniform(0.7, 1.0, len(sizes))
        groups.append(best_fit(sizes, np.argsort(-noise, kind="stable").tolist(), [], capacity))
    scored = sorted(((fitness(sizes, b, capacity), k) for k, b in enumerate(groups)), reverse=True)
    for _ in range(generations):
        ranked = [groups[k] for _, k in scored]
        if len(ranked[0]) <= least:
            break
        half = ranked[: max(2, population // 2)]
        children = []
        while len(half) + len(children) < population:
            a, b = rng.choice(len(half), 2, replace=False)
            children.append(mutate(sizes, cross(sizes, half[a], half[b], capacity, rng), capacity, rng))
        groups = half + children
        scored = sorted(((fitness(sizes, b, capacity), k) for k, b in enumerate(groups)), reverse=True)
    return groups[scored[0][1]]


def _solve(items: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """(row, length, cell, bin, offset, fill) of the items (row, length, cell)."""
    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)

    def as_bins(raw) -> list[list[int]]:
        where = np.frombuffer(raw, "<i4")
        places = np.argsort(where, kind="stable")
        return [list(map(int, b)) for b in np.split(places, np.flatnonzero(np.diff(where[places])) + 1)]

    def epoch(k: int):
        def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            forget()  # the pieces are written, and this worker may have cut some
            if left.empty:
                return pd.DataFrame({c: [] for c in ("cell", "island", "bins", "fit", "solution")})
            sizes = in_order(left)["length"].to_numpy()
            elite = as_bins(right["solution"].iloc[0]) if len(right) else None
            seed = (int(key[0]) * 1_000_003 + int(key[1])) * 31 + k
            found = evolve(sizes, capacity, seed, elite, population, generations)
            where = np.empty(len(sizes), "<i4")
            for number, b in enumerate(found):
                where[b] = number
            n, fit = fitness(sizes.tolist(), found, capacity)
            return pd.DataFrame({
                "cell": [key[0]], "island": [key[1]], "bins": [-n], "fit": [fit], "solution": [where.tobytes()],
            })

        return run

    slim = items.select("cell", "row", "length")  # no nulls, so pandas keeps whole numbers
    on_islands = slim.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    schema = "cell long, island int, bins long, fit double, solution binary"
    elites = items.sparkSession.createDataFrame([], schema)
    for k in range(epochs):
        moved = elites.withColumn("island", (F.col("island") + 1) % islands)
        elites = stage(
            on_islands.groupBy("cell", "island").cogroup(moved.groupBy("cell", "island")).applyInPandas(epoch(k), schema),
            "islands",
        )
    best = elites.groupBy("cell").agg(
        F.max_by("solution", F.struct(-F.col("bins"), F.col("fit"), -F.col("island"))).alias("solution")
    )

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = in_order(left)
        rows["bin"] = np.frombuffer(right["solution"].iloc[0], "<i4").astype("int64") if len(rows) else []
        rows = rows.sort_values(["bin", "row"], kind="stable")
        rows["offset"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
        rows["fill"] = rows.groupby("bin")["length"].transform("sum")
        return rows[["row", "length", "cell", "bin", "offset", "fill"]]

    placed = slim.groupBy("cell").cogroup(best.groupBy("cell")).applyInPandas(
        place, "row long, length long, cell long, bin long, offset long, fill long"
    )
    return stage(placed, "placed")


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, cell_items: int = 2048, islands: int = 2, epochs: int = 2,
    population: int = 6, generations: int = 4, solid: float = 0.97, stall: float = 0.75,
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces."""
    columns = list(pieces.columns)
    pieces = stage(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == capacity).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < capacity).select("row", "length")
    done, level = None, 0
    while True:
        items, left = dealt(rest, cell_items)
        if not left:
            break
        placed = _solve(items, capacity, islands, epochs, population, generations)
        poor = F.col("fill") < solid * capacity
        again = placed.where(poor).count() if left > cell_items else 0
        if again > stall * left:
            again = 0
        if not again:
            poor = F.lit(False)
        # A level has less than 2 ** 24 sequences in a cell and 2 ** 32 cells.
        number = F.shiftleft(F.lit(level).cast("long"), 56) + F.shiftleft(F.col("cell"), 24) + F.col("bin")
        solid_rows = placed.where(~poor).select("row", number.alias("sequence_id"), "offset")
        done = solid_rows if done is None else done.unionByName(solid_rows)
        if not again:
            break
        rest, level = placed.where(poor).select("row", "length"), level + 1
    if done is None:
        return full
    return full.unionByName(pieces.join(done, "row").select(*columns, "sequence_id", "offset"))


def dealt(rest: DataFrame, cell_items: int) -> tuple[DataFrame, int]:
    """(row, length, cell) with at most ``cell_items`` rows in a cell, and the number of rows.

    Rows are numbered without gaps, from the sizes of the partitions of a written table, and
    dealt in turn; so cells stay bounded whatever ids and copies the table holds.
    """
    at = F.monotonically_increasing_id()
    rows = stage(rest.withColumn("part", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND((1 << 33) - 1)), "rests")
    sizes = sorted(map(tuple, rows.groupBy("part").count().collect()))  # one number per partition
    left = sum(n for _, n in sizes)
    if not left:
        return rows.limit(0).select("row", "length", F.lit(0).cast("long").alias("cell")), 0
    before, heads = 0, []
    for part, n in sizes:
        heads.append((part, before))
        before += n
    heads = rows.sparkSession.createDataFrame(heads, "part long, head long")
    cells = -(-left // cell_items)
    numbered = rows.join(F.broadcast(heads), "part")
    return numbered.select("row", "length", ((F.col("head") + F.col("at")) % cells).alias("cell")), left


@query("op5_packing")
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack(cut_pieces(documents(spark, sf), vocabulary("word_bpe_49k.json"), False, 0))
