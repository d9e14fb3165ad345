"""Rolling spectrum of the rows before the current one.

A Fourier transform per row is the one feature that Spark's expressions cannot
state at a sensible cost, so each block is handed to numpy as one Arrow table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_CHUNK = 8192


def window_spectra(x: np.ndarray, window: int, top: int, rate: float) -> np.ndarray:
    """Total power, centroid and the ``top`` bins of every full window of ``x``.

    Row ``i`` describes ``x[i : i + window]`` after a symmetric Hann window;
    equal powers are ranked by the lower bin.
    """
    freqs = np.fft.rfftfreq(window, d=1.0 / rate)
    taper = np.hanning(window)
    views = np.lib.stride_tricks.sliding_window_view(x, window)
    out = np.empty((len(views), 2 + 2 * top))
    for a in range(0, len(views), _CHUNK):
        power = np.abs(np.fft.rfft(views[a : a + _CHUNK] * taper, axis=1)) ** 2
        total = power.sum(axis=1)
        part = out[a : a + _CHUNK]
        part[:, 0] = total
        with np.errstate(invalid="ignore", divide="ignore"):
            part[:, 1] = np.where(total > 0, power @ freqs / total, np.nan)
        best = np.argsort(-power, axis=1, kind="stable")[:, :top]
        part[:, 2::2] = freqs[best]
        part[:, 3::2] = np.take_along_axis(power, best, axis=1)
    return out


@dataclass(frozen=True)
class Spectrum:
    """Spectral features; the first ``window`` rows repeat the first full window's."""

    window: int = 100
    top: int = 5
    sampling_rate: int = 10_000
    base: str = "OptPow"

    def reach(self):
        return self.window, 0

    def names(self):
        stem = f"{self.base}_spectral"
        ranked = [f"{stem}_{s}{i + 1}" for i in range(self.top) for s in ("freq", "power")]
        return [f"{stem}_power_total", f"{stem}_centroid", *ranked]

    def apply(self, df: DataFrame, frame, keep: list[str]) -> DataFrame:
        names, window, top, rate, base = (
            self.names(), self.window, self.top, self.sampling_rate, self.base,
        )
        fields = [df.schema[c] for c in keep]
        schema = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in names])

        def block(table: pa.Table) -> pa.Table:
            seq = table.column("seq").to_numpy()
            if np.any(np.diff(seq) < 0):
                order = np.argsort(seq, kind="stable")
                table, seq = table.take(pa.array(order)), seq[order]
            x = table.column(base).to_numpy(zero_copy_only=False).astype("float64")
            values = np.full((len(seq), len(names)), np.nan)
            if len(seq) > window:
                values[window:] = window_spectra(x[:-1], window, top, rate)
                head = seq < window
                values[head] = values[np.searchsorted(seq, window)]
            own = table.column("_own").to_numpy(zero_copy_only=False).astype(bool)
            columns = [table.column(c).combine_chunks() for c in keep]
            columns += [pa.array(v, from_pandas=True) for v in values.T]
            return pa.Table.from_arrays(columns, names=[*keep, *names]).filter(pa.array(own))

        inputs = dict.fromkeys([*keep, "seq", base, "_own", *frame.part])
        return df.select(*inputs).groupBy(*frame.part).applyInArrow(block, schema)
