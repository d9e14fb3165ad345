"""Features of live signals: the state of every link in a ring buffer, rows put in order first.

The features are those of the batch families (`operators.windows`): first difference, lagged
differences, trailing statistics and exponential averages. State per link:

* ``pending``: rows that the watermark has not passed, which earlier rows may still precede, in pieces by
  six hours of time, so that rows are added without reading any and Python never holds more than
  ``SLICE`` rows and those of six hours;
* ``ring``: the newest samples in order, as many as the longest feature reaches back, with the
  number of samples so far and the running averages.

When the watermark passes pending rows (a timer at the earliest of them says so), they are taken in
order of (time, order column), and their features are given out. Rows later than the delay are dropped
by the watermark, so what comes out equals the batch features of the rows that were in time, and a
restart from the checkpoint goes on where it stood. State per link is bounded by the delay and the
longest window.

Missing values (null or NaN) are samples of the signal: differences, lags and averages
that touch them are null until they have left the window or, for the average, for good; trailing
statistics leave them out. Rows without a time or a link have no place in a signal and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RING = "seq long, ring array<double>, averages array<double>"
PIECE = "bucket long, piece long"
PENDING = "at array<long>, row array<long>, x array<double>"
BUCKET = 6 * 3_600_000_000  # microseconds of time whose rows are put in order at once
TYPES = ("int64", "int64", "float64")
SLICE = 20_000  # rows that are written to the state, or given out, at once


@dataclass(frozen=True)
class Spec:
    """What to compute; names are those of the batch features."""

    taps: tuple[int, ...] = (1, 2, 3, 4, 5)
    windows: tuple[int, ...] = (5, 20)
    alphas: tuple[float, ...] = (0.1, 0.3)
    base: str = "x"

    @property
    def reach(self) -> int:
        """Samples that a feature may need, the newest included."""
        return max(max(self.taps, default=0) + 2, max(self.windows, default=1), 2)

    def names(self) -> list[str]:
        b = self.base
        return [
            f"{b}_diff", *[f"{b}_diff_lag{k}" for k in self.taps],
            *[f"{b}_rolling_{s}_{w}" for w in self.windows for s in ("mean", "std", "min", "max")],
            *[f"{b}_ema_{str(a).replace('.', '_')}" for a in self.alphas],
        ]

    def schema(self, key: str) -> str:
        return f"`{key}` string, row long, seq long, {self.base} double, " + ", ".join(f"{n} double" for n in self.names())


def features_of(spec: Spec, before: np.ndarray, x: np.ndarray, averages: np.ndarray, first: bool):
    """(columns, averages after) of the samples ``x`` that follow ``before``; missing samples are NaN."""
    joined = np.concatenate([before, x])
    n, at = len(x), len(before)
    diff = np.full(len(joined), np.nan)
    diff[1:] = joined[1:] - joined[:-1]

    def back(values: np.ndarray, k: int) -> np.ndarray:
        out = np.full(n, np.nan)
        skip = max(0, k - at)
        out[skip:] = values[at + skip - k: at + n - k]
        return out

    columns = [back(diff, 0), *[back(diff, k) for k in spec.taps]]
    for w in spec.windows:
        padded = np.concatenate([np.full(max(0, w - 1 - at), np.nan), joined[max(0, at - w + 1):]])
        frames = np.lib.stride_tricks.sliding_window_view(padded, w)
        known = ~np.isnan(frames)
        count = known.sum(axis=1)
        filled = np.where(known, frames, 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = filled.sum(axis=1) / count
            square = (np.where(known, frames - mean[:, None], 0.0) ** 2).sum(axis=1)
            std = np.where(count > 1, np.sqrt(square / (count - 1)), np.nan)
        low = np.where(count > 0, np.where(known, frames, np.inf).min(axis=1), np.nan)
        high = np.where(count > 0, np.where(known, frames, -np.inf).max(axis=1), np.nan)
        columns += [np.where(count > 0, mean, np.nan), std, low, high]
    after = averages.copy()
    for i, a in enumerate(spec.alphas):
        out = np.empty(n)
        e = x[0] if first else averages[i]
        for k, v in enumerate(x):
            e = (1 - a) * e + a * v
            out[k] = e
        columns.append(out)
        after[i] = e
    return columns, after


class OnlineFeatures(StatefulProcessor):
    def __init__(self, key: str, spec: Spec):
        self.key, self.spec = key, spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", RING)
        self.pending = handle.getMapState("pending", PIECE, PENDING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = {bucket: pieces[-1] for bucket, pieces in self._pieces().items()}
        some, n = [], 0
        for pdf in rows:
            some.append(pdf[["at", "row", "x"]])
            n += len(pdf)
            if n >= SLICE:
                self._keep(pd.concat(some, ignore_index=True), last)
                some, n = [], 0
        if n:
            self._keep(pd.concat(some, ignore_index=True), last)
        yield from self._release(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues)

    def close(self) -> None:
        pass

    def _pieces(self) -> dict[int, list[int]]:
        """The pieces of every bucket, both in order."""
        found: dict[int, list[int]] = {}
        if self.pending.exists():
            for bucket, piece in sorted(tuple(k) for k in self.pending.keys()):
                found.setdefault(bucket, []).append(piece)
        return found

    def _put(self, bucket: int, piece: int, rows: tuple) -> None:
        self.pending.updateValue((bucket, piece), tuple(column.tolist() for column in rows))

    def _keep(self, rows: pd.DataFrame, last: dict[int, int]) -> None:
        """Add rows as pieces behind the ``last`` one of each bucket."""
        columns = [rows[c].to_numpy(t) for c, t in zip(("at", "row", "x"), TYPES)]
        home = columns[0] // BUCKET
        order = np.argsort(home, kind="stable")
        columns, home = [c[order] for c in columns], home[order]
        cuts = [0, *(np.flatnonzero(np.diff(home)) + 1), len(home)]
        for lo, hi in zip(cuts, cuts[1:]):
            bucket = int(home[lo])
            last[bucket] = last.get(bucket, -1) + 1
            self._put(bucket, last[bucket], tuple(c[lo:hi] for c in columns))

    def _bucket(self, bucket: int, pieces: list[int]) -> tuple:
        """The columns of a bucket's rows as they came."""
        some = [self.pending.getValue((bucket, p)) for p in pieces]
        return tuple(np.concatenate([np.array(s[i], t) for s in some]) for i, t in enumerate(TYPES))

    def _release(self, key, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        given = self.ring.get() if self.ring.exists() else (0, [], [0.0] * len(self.spec.alphas))
        state, some, n, earliest = given, [], 0, None
        for bucket, pieces in self._pieces().items():
            rows = self._bucket(bucket, pieces)
            due = rows[0] <= mark
            if due.any():
                order = np.lexsort((rows[1], rows[0]))
                some.append(tuple(c[order][due[order]] for c in rows[1:]))
                n += int(due.sum())
                for piece in pieces:
                    self.pending.removeKey((bucket, piece))
                if not due.all():
                    self._put(bucket, pieces[0], tuple(c[~due] for c in rows))
            if not due.all():
                # Later buckets wait as well, and need not be read.
                earliest = int(rows[0][~due].min())
                break
            if n >= SLICE:
                out, state = self._features(key, some, state)
                some, n = [], 0
                yield out
        if n:
            out, state = self._features(key, some, state)
            yield out
        if state is not given:
            self.ring.update(state)
        if earliest is not None:
            # Fires once the watermark is past the earliest waiting row.
            self.handle.registerTimer(earliest // 1000)

    def _features(self, key, ready: list[tuple], state) -> tuple[pd.DataFrame, tuple]:
        """The features of rows in order, and the state after them."""
        seq, ring, averages = int(state[0]), *state[1:]
        row, x = (np.concatenate(columns) for columns in zip(*ready))
        before = np.array(ring, float)
        columns, after = features_of(self.spec, before, x, np.array(averages, float), seq == 0)
        keep = np.concatenate([before, x])[-self.spec.reach:]
        out = pd.DataFrame({
            self.key: [key[0]] * len(x), "row": row, "seq": np.arange(seq, seq + len(x)),
            self.spec.base: x, **dict(zip(self.spec.names(), columns)),
        })
        return out, (seq + len(x), keep.tolist(), after.tolist())


def online_features(
    stream: DataFrame, key: str, ts: str, order: str, value: str, delay: str, spec: Spec = Spec(),
) -> DataFrame:
    """(key, row, seq, level, features): ``row`` is the order column, which tells rows of one time apart.

    The stream must be started under ``runs.settings`` with the RocksDB state store.
    """
    at = F.col(ts).cast("timestamp")
    rows = stream.select(
        F.col(key).cast("string").alias("link"), at.alias("event_time"), F.unix_micros(at).alias("at"),
        F.col(order).cast("long").alias("row"), F.col(value).cast("double").alias("x"),
    ).where("link IS NOT NULL AND at IS NOT NULL AND row IS NOT NULL").withWatermark("event_time", delay)
    found = rows.groupBy("link").transformWithStateInPandas(
        OnlineFeatures(key, spec), outputStructType=spec.schema(key), outputMode="Append", timeMode="EventTime",
    )
    null = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select(key, "row", "seq", *[null(c) for c in (spec.base, *spec.names())])
