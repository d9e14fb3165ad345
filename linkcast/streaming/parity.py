"""Does a stream that was stopped and started again give what a batch gives?"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from linkcast.streaming.runs import drain, feed
from linkcast.streaming.scoring import Write


def crash_after(write: Write, batch_id: int) -> Write:
    """Writes, and fails at one batch after its rows are written and before it is committed."""

    def crash(batch: DataFrame, number: int) -> None:
        write(batch, number)
        if number == batch_id:
            raise RuntimeError(f"interrupted after batch {number}")

    return crash


def replay(
    parts: list[DataFrame], folder: str, checkpoint: str, write: Write,
    start: Callable[[Write], DataStreamWriter], crash_at: int,
) -> int:
    """Feed the parts with a run after each. The run that reaches the batch ``crash_at`` ends there; the
    next one goes on from the checkpoint, with that batch once more. The number of such ends."""
    ends = 0

    def run() -> list[dict]:
        nonlocal ends
        if not ends:
            try:
                return drain(start(crash_after(write, crash_at)), checkpoint)
            except StreamingQueryException as stopped:
                if "interrupted after batch" not in str(stopped):
                    raise
                ends += 1
        return drain(start(write), checkpoint)

    feed(parts, folder, run)
    return ends


def differing(stream: DataFrame, batch: DataFrame, keys: Sequence[str], digits: int = 6) -> DataFrame:
    """Rows that are in one table only or differ in a column, as (keys, found in, columns that differ)."""
    values = [c for c in batch.columns if c not in keys]
    types = dict(batch.dtypes)

    def side(df: DataFrame, name: str) -> DataFrame:
        number = lambda c: F.round(c, digits) + F.lit(0.0) if types[c] == "double" else F.col(c)
        return df.groupBy(*keys).agg(
            F.count("*").alias(f"{name}__rows"), *[F.first(number(c)).alias(f"{name}_{c}") for c in values]
        )

    both = side(stream, "s").join(side(batch, "b"), list(keys), "full")
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"s_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in ["_rows", *values]
    ]))
    return both.select(
        *keys, F.col("s__rows").isNotNull().alias("in_stream"), F.col("b__rows").isNotNull().alias("in_batch"),
        changed.alias("changed"),
    ).where(F.size("changed") > 0)


def summary(stream: DataFrame, batch: DataFrame, keys: Sequence[str], restarts: int, digits: int = 6) -> DataFrame:
    """One row: (n_stream, n_batch, n_differing, restarts)."""
    bad = differing(stream, batch, keys, digits)
    rows = [df.select(F.lit(name).alias("of")) for name, df in (("stream", stream), ("batch", batch), ("differing", bad))]
    counts = [F.count_if(F.col("of") == name).alias(f"n_{name}") for name in ("stream", "batch", "differing")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(*counts, F.lit(restarts).cast("long").alias("restarts"))
