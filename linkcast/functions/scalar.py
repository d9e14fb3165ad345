"""Column expressions: unit conversions, percentages and guarded statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def power_to_db(col, nonpositive: str = "error") -> Column:
    """``10 * log10(x)``; values <= 0 raise or become null."""
    x = _c(col).cast("double")
    if nonpositive == "error":
        bad = F.raise_error(F.lit("power must be positive for a decibel conversion"))
        return F.when(x <= 0, bad.cast("double")).otherwise(10 * F.log10(x))
    return F.when(x > 0, 10 * F.log10(x))


def dbm_to_watts(col) -> Column:
    return F.pow(F.lit(10.0), (_c(col) - 30) / 10)


def power_to_irradiance(col, diameter: float) -> Column:
    """Power over a round aperture of ``diameter``."""
    return _c(col) / F.lit(math.pi * (diameter / 2) ** 2)


def samples_to_ms(col, sampling_rate: int = 10_000) -> Column:
    return _c(col) / F.lit(float(sampling_rate)) * 1000


def improvement_pct(baseline, value) -> Column:
    """How far ``value`` lies below ``baseline``, in percent of ``baseline``."""
    return F.try_divide(_c(baseline) - _c(value), _c(baseline)) * 100


def increase_pct(start, end) -> Column:
    """Growth from ``start`` to ``end``, in percent of ``start``."""
    return F.try_divide(_c(end) - _c(start), _c(start)) * 100


def pearson(x, y) -> Column:
    """Correlation aggregate; null where a variance is zero."""
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def rmse(err) -> Column:
    return F.sqrt(F.avg(_c(err) * _c(err)))


def r_squared(y, err) -> Column:
    """1 - SSE / SST; null for a constant target."""
    sst = F.var_pop(_c(y)) * F.count(_c(y))
    return 1 - F.try_divide(F.sum(_c(err) * _c(err)), sst)


def is_missing(col) -> Column:
    return _c(col).isNull() | F.isnan(_c(col))
