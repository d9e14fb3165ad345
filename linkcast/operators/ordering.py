"""Positions in an ordered series, and ordered windows over very long series.

A window partitioned by the series alone puts a whole series into one task.
Two steps avoid that:

* ``index_series`` numbers the rows 0, 1, 2, ... per series. Short series (their
  size is counted first) use ``row_number``; long ones are range-partitioned,
  numbered inside each partition and shifted by the rows before it.
* ``spread`` cuts every series into blocks of rows and copies the few rows a
  window frame reaches over a border (the halo) into the neighbouring block.
  Frames then run per (series, block) and halo rows are dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkcast.session import stage

SHORT_SERIES = 1_000_000  # rows one window task may hold
RANGE_ROWS = 1_000_000  # rows per range partition
MAX_RANGES = 256  # range partitions of fewer rows than that, at most
BLOCK_ROWS = 32_768  # rows per block, at most (longer only for a longer reach)
MIN_BLOCK_ROWS = 2_048
TASK_ROWS = 4_000_000  # rows per task of a window stage, at most
SMALL_CELLS = 2_000_000  # rows times columns of a table that may be broadcast


@dataclass(frozen=True)
class Signal:
    """An indexed signal: key columns, ``seq`` and value columns."""

    df: DataFrame
    keys: tuple[str, ...]
    rows: int
    longest: int
    n_series: int
    block_rows: int = BLOCK_ROWS

    def with_df(self, df: DataFrame) -> "Signal":
        return replace(self, df=df)

    def with_blocks(self, block_rows: int) -> "Signal":
        return replace(self, block_rows=block_rows)

    def attach(self, table: DataFrame) -> DataFrame:
        """Join a table that has one row per series."""
        return join_by_keys(self.df, table, self.keys, self.n_series)


def join_by_keys(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    table_rows: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Equi-join that broadcasts ``table`` only when its counted size is small.

    Null keys match null keys, so that a series without a name keeps its rows. Larger
    tables and those of unknown size are shuffled; adaptive execution then splits the
    partitions of hot keys.
    """
    keys = list(keys)
    rest = [c for c in table.columns if c not in keys]
    other = table.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *rest)
    if table_rows is not None and table_rows * len(table.columns) <= SMALL_CELLS:
        other = F.broadcast(other)
    match = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    joined = df.join(other, reduce(and_, match) if match else F.lit(True), how)
    return joined.select(*keys, *[c for c in df.columns if c not in keys], *rest)


def series_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int, int]:
    """All rows, rows of the longest series, number of series."""
    row = (
        df.groupBy(*keys)
        .count()
        .agg(F.sum("count").alias("n"), F.max("count").alias("m"), F.count("*").alias("s"))
        .first()
    )
    return row.n or 0, row.m or 0, row.s or 0


def index_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    keep: Sequence[str] = (),
    short_series: int = SHORT_SERIES,
    range_rows: int = RANGE_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> Signal:
    """Number the rows of every series by ``order`` (whose last column breaks ties)."""
    keys, order = list(keys), list(order)
    df = df.select(*dict.fromkeys([*keys, *order, *keep]))
    rows, longest, n_series = series_sizes(df, keys)
    if longest <= short_series:
        w = Window.partitionBy(*keys).orderBy(*order)
        numbered = df.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))
    else:
        # The driver hears from every partition, so small ones must not grow in number with the rows.
        parts = min(ceil(rows / range_rows), max(MAX_RANGES, ceil(rows / RANGE_ROWS)))
        numbered = _index_ranges(df, keys, order, max(2, parts))
    numbered = numbered.select(*keys, "seq", *keep)
    return Signal(numbered, tuple(keys), rows, longest, n_series, block_rows)


def _index_ranges(df: DataFrame, keys: list[str], order: list[str], parts: int) -> DataFrame:
    # monotonically_increasing_id holds the partition in its upper bits and the
    # row's position in the sorted partition in its lower 33 bits.
    placed = stage(
        df.repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_id", F.monotonically_increasing_id()),
        "ranges",
    )
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn(
        "_pos", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stage(
        placed.groupBy(*keys, "_part")
        .agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
        .select(
            *keys,
            "_part",
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        ),
        "runs",
    )
    joined = join_by_keys(placed, runs, [*keys, "_part"], runs.count())
    return joined.withColumn("seq", F.col("_pos") + F.col("_shift"))


class Frame:
    """Ordered row frames over the partitioning chosen by ``spread``."""

    def __init__(self, part: Sequence[str], order: Sequence[str]):
        self.part = list(part)
        self.base = Window.partitionBy(*part).orderBy(*order)

    def lag(self, col: Column | str, k: int, default=None) -> Column:
        return (F.lag if k >= 0 else F.lead)(col, abs(k), default).over(self.base)

    def over(self, agg: Column, lo: int, hi: int) -> Column:
        """``agg`` over the rows ``lo`` .. ``hi`` relative to the current one."""
        return agg.over(self.base.rowsBetween(lo, hi))

    def running(self, agg: Column) -> Column:
        return agg.over(self.base.rowsBetween(Window.unboundedPreceding, 0))

    def whole(self, agg: Column) -> Column:
        return agg.over(
            self.base.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )

    def in_run(self, agg: Column, run: str) -> Column:
        """Running ``agg`` that restarts whenever ``run`` changes."""
        w = Window.partitionBy(*self.part, run).orderBy("seq")
        return agg.over(w.rowsBetween(Window.unboundedPreceding, 0))

    def previous_run(self, agg: Column, run: str) -> Column:
        """``agg`` over all rows of the run just before the current one."""
        return agg.over(Window.partitionBy(*self.part).orderBy(run).rangeBetween(-1, -1))


def spread(sig: Signal, back: int, ahead: int, run_rows: int | None = None):
    """Partition a signal for frames that reach ``back`` and ``ahead`` rows.

    Returns the rows with their halo copies, the frames to use, and the
    condition that keeps each row once. ``run_rows`` adds a ``_run`` number
    (``floor(seq / run_rows)``); it leads the sort order so that frames per run
    and frames per block share one sort.
    """
    # Blocks shrink on small inputs so that every core gets some of them.
    tasks = window_tasks(sig)
    even = min(sig.block_rows, max(MIN_BLOCK_ROWS, sig.rows // (4 * tasks)))
    size = max(even, 4 * (back + ahead))
    df, part, own = sig.df, list(sig.keys), F.lit(True)
    if run_rows:
        df = df.withColumn("_run", F.floor(F.col("seq") / run_rows))
    order = ["_run", "seq"] if run_rows else ["seq"]
    if sig.longest <= size:
        # One exchange serves every window below, whatever it is partitioned by;
        # the one that numbered the rows is reused where it still holds.
        return df.repartition(*part), Frame(part, order), own
    home = F.floor(F.col("seq") / size)
    first = F.greatest(F.floor((F.col("seq") - ahead) / size), F.lit(0))
    last = F.floor((F.col("seq") + back) / size)
    df = df.withColumn("_block", F.explode(F.sequence(first, last)))
    part, own = [*part, "_block"], F.col("_block") == home
    # A stated number keeps adaptive execution from merging the few bytes of a
    # small signal into one task, although its windows are all computation.
    return df.repartition(tasks, *part), Frame(part, order), own


def window_tasks(sig: Signal) -> int:
    """Tasks of a window stage: all cores for small signals, bounded rows for large ones."""
    usual = int(sig.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(ceil(sig.rows / TASK_ROWS), min(usual, ceil(sig.rows / MIN_BLOCK_ROWS)), 1)
