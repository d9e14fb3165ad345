"""Turbulence strength per link: fit a density model to the irradiance histogram.

All links and all candidate strengths are compared in one job per round; each
round narrows every link's interval around its best candidate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcast.functions.density import gammagamma_pdf, lognormal_pdf
from linkcast.functions.scalar import power_to_irradiance
from linkcast.operators.ordering import Signal, join_by_keys, window_tasks
from linkcast.operators.stats import density
from linkcast.operators.windows import FastFading, add_features
from linkcast.session import stage

# Receiver aperture in metres, averaging window, histogram size,
# smallest bin share, and the strength below which the log-normal model is used.
APERTURE = 7e-3
FADING_WINDOW = 1000
BINS = 150_000
SHARE_FLOOR = 1e-6
WEAK_LIMIT = 0.03
SEARCH_RANGE = (1e-4, 20.0)
CANDIDATES = 40


def fast_fading(sig: Signal, power: str, window: int = FADING_WINDOW) -> DataFrame:
    """(keys, seq, fading): irradiance over its centred moving mean."""
    lit = sig.with_df(sig.df.withColumn("irradiance", power_to_irradiance(power, APERTURE)))
    out = add_features(lit, [FastFading(window, "irradiance")])
    return out.withColumnRenamed("irradiance_fading", "fading")


def _gammagamma_errors(batches: Iterator[pd.DataFrame], keys, steps) -> Iterator[pd.DataFrame]:
    """Squared errors of every candidate, summed per batch and link."""
    for pdf in batches:
        for key, rows in pdf.groupby(keys, sort=False):
            key = key if isinstance(key, tuple) else (key,)
            lo, hi = rows["lo"].iat[0], rows["hi"].iat[0]
            for i in range(steps + 1):
                strength = lo * (hi / lo) ** (i / steps)
                err = gammagamma_pdf(strength, rows["x"].to_numpy()) - rows["y"].to_numpy()
                good = np.isfinite(err)
                record = dict(zip(keys, key))
                record |= {"i": i, "sse": float((err[good] ** 2).sum()), "n": int(good.sum())}
                yield pd.DataFrame([record])


def candidate_errors(
    hist: DataFrame, keys: Sequence[str], ranges: DataFrame, model: str, n_series: int, steps: int
) -> DataFrame:
    """(keys, i, candidate, mse) for ``steps + 1`` strengths between lo and hi."""
    keys = list(keys)
    j = join_by_keys(hist, ranges, keys, n_series)
    grid = F.col("lo") * F.pow(F.col("hi") / F.col("lo"), F.col("i") / F.lit(float(steps)))
    if model == "lognormal":
        tried = j.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
        err = lognormal_pdf(grid, F.col("x")) - F.col("y")
        summed = tried.groupBy(*keys, "i").agg(
            F.sum(err * err).alias("sse"), F.count(err).alias("n"), F.max("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
    else:
        fields = ", ".join(f"`{k}` {hist.schema[k].dataType.simpleString()}" for k in keys)
        parts = j.mapInPandas(
            lambda it: _gammagamma_errors(it, keys, steps), f"{fields}, i int, sse double, n long"
        )
        summed = join_by_keys(
            parts.groupBy(*keys, "i").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n")),
            ranges, keys, n_series,
        )
    return summed.select(
        *keys, "i", grid.alias("candidate"), F.try_divide("sse", "n").alias("mse"), "lo", "hi"
    )


def search(
    hist: DataFrame, keys: Sequence[str], model: str, n_series: int, rounds: int = 4, steps: int = CANDIDATES
) -> DataFrame:
    """(keys, strength, mse) of the best candidate after narrowing ``rounds`` times."""
    keys = list(keys)
    ranges = hist.select(*keys).distinct().withColumns(
        {"lo": F.lit(SEARCH_RANGE[0]), "hi": F.lit(SEARCH_RANGE[1])}
    )
    for r in range(rounds):
        errors = candidate_errors(hist, keys, ranges, model, n_series, steps)
        best = errors.groupBy(*keys).agg(
            F.min_by(F.struct("candidate", "mse", "lo", "hi"), F.struct("mse", "i")).alias("_b")
        ).select(*keys, "_b.*")
        if r == rounds - 1:
            return best.select(*keys, F.col("candidate").alias("strength"), "mse")
        ratio = F.pow(F.col("hi") / F.col("lo"), F.lit(1.0 / steps))
        ranges = stage(
            best.select(
                *keys, (F.col("candidate") / ratio).alias("lo"), (F.col("candidate") * ratio).alias("hi")
            ),
            "ranges",
        )


def turbulence_strength(
    sig: Signal, power: str, bins: int = BINS, window: int = FADING_WINDOW, rounds: int = 4
) -> DataFrame:
    """(keys, strength, mse, model) per link from its power in watts."""
    keys = list(sig.keys)
    fading = fast_fading(sig, power, window)
    hist = density(fading, keys, "fading", bins, SHARE_FLOOR, sig.n_series)
    # The fit is all computation: spread the bins of each link over the cores.
    hist = stage(hist.repartition(window_tasks(sig)), "density")
    strong = search(hist, keys, "gammagamma", sig.n_series, rounds).withColumn(
        "model", F.lit("gammagamma")
    )
    strong = stage(strong, "strength")
    weak_keys = strong.where(F.col("strength") < WEAK_LIMIT).select(*keys)
    weak = search(hist.join(weak_keys, keys, "left_semi"), keys, "lognormal", sig.n_series, rounds)
    weak = weak.withColumn("model", F.lit("lognormal"))
    return strong.where(F.col("strength") >= WEAK_LIMIT).unionByName(weak)
