"""Densities of normalised irradiance under atmospheric turbulence."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def lognormal_pdf(variance: Column, x: Column) -> Column:
    """Log-normal density with unit mean; null for x <= 0."""
    z = F.ln(x) + variance / 2
    value = F.exp(-(z * z) / (2 * variance)) / (x * F.sqrt(variance * (2 * math.pi)))
    return F.when((x > 0) & (variance > 0), value)


def eddy_numbers(variance):
    """Large- and small-scale eddy numbers of a plane wave (Al-Habash et al., 2001)."""
    # Fixed values of the published formulas.
    s = np.asarray(variance, dtype=float)
    s65 = s**1.2
    large = 0.49 * s / (1 + 1.11 * s65) ** (7 / 6)
    small = 0.51 * s / (1 + 0.69 * s65) ** (5 / 6)
    return 1 / np.expm1(large), 1 / np.expm1(small)


def log_bessel_k(order, z, points: int = 96):
    """log K_order(z) from the integral of exp(-z cosh t) cosh(order t)."""
    v, z = np.abs(np.asarray(order, float))[..., None], np.asarray(z, float)[..., None]
    # Far enough that the integrand has fallen 26 decades below its peak.
    peak = np.arcsinh(v / z)
    height = v * peak - z * (np.cosh(peak) - 1)
    end = np.arccosh(1 + (60 + height) / z)
    for _ in range(3):
        end = np.arccosh(1 + (60 + v * end - np.maximum(height, 0)) / z)
    step = end / points
    t = step * np.arange(points + 1)
    expo = -z * (np.cosh(t) - 1) + v * t + np.log1p(np.exp(-2 * v * t)) - math.log(2)
    top = expo.max(axis=-1, keepdims=True)
    terms = np.exp(expo - top)
    terms[..., 0] *= 0.5
    total = terms.sum(axis=-1, keepdims=True) * step
    return (np.log(total) + top - z)[..., 0]


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def gammagamma_pdf(variance, x):
    """Gamma-gamma density of irradiance ``x`` at a turbulence strength (Rytov variance)."""
    a, b = eddy_numbers(variance)
    x = np.asarray(x, float)
    k = (a + b) / 2
    safe = np.where(x > 0, x, 1.0)
    logs = (
        math.log(2)
        + k * np.log(a * b)
        - _lgamma(a)
        - _lgamma(b)
        + (k - 1) * np.log(safe)
        + log_bessel_k(a - b, 2 * np.sqrt(a * b * safe))
    )
    return np.where(x > 0, np.exp(logs), np.nan)
