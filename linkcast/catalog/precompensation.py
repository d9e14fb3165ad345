"""Naive pre-compensation over a range of latencies and turbulence statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkcast.catalog.common import CFG, RAW, SIG, W, db_signal, query, r, raw_signal, rounded
from linkcast.config import SWEEP_LATENCIES
from linkcast.functions.density import lognormal_pdf
from linkcast.operators.stats import density
from linkcast.plans import precompensation as pre
from linkcast.plans.turbulence import fast_fading, search, turbulence_strength

N_TRAIN = 1_000
_VALUES = ", ".join(f"({h})" for h in SWEEP_LATENCIES)
_NAIVE = f"""{SIG}, lg AS (
  SELECT series, h.latency, seq, x, lag(x, h.latency) OVER o AS p,
         lag(x, h.latency + 10) OVER o AS oldest
  FROM sig, (VALUES {_VALUES}) h(latency) WINDOW o AS (PARTITION BY series, h.latency ORDER BY seq)),
k AS (SELECT *, row_number() OVER (PARTITION BY series, latency ORDER BY seq) - 1 AS i FROM lg WHERE oldest IS NOT NULL),
t AS (SELECT *, x - p AS residual FROM k WHERE i >= {N_TRAIN})"""


def naive_residuals(spark, sf):
    """Residuals of the naive forecast at every latency."""
    rows = pre.sweep_rows(db_signal(spark, sf), SWEEP_LATENCIES, N_TRAIN, CFG, inputs=False)
    return pre.naive_residuals(rows, ["series"])


@query("naive_forecast_error", f"""WITH {SIG}, p AS (
  SELECT series, seq, x, lag(x, 5) OVER ({W}) AS p, lag(x, 15) OVER ({W}) AS oldest FROM sig)
SELECT series, 5 AS horizon, {r('sqrt(avg((x - p) * (x - p)))', 'rmse')}, {r('avg(abs(x - p))', 'mae')},
       {r('var_pop(x - p)', 'residual_variance')}, count(*) AS n
FROM p WHERE oldest IS NOT NULL GROUP BY series""")
def naive_forecast_error(spark, sf):
    """Decibel signal, lags and target, complete rows, error of "no change"."""
    sig = db_signal(spark, sf)
    cfg = pre.lag_config((5,), CFG)
    from linkcast.plans.features import engineer_features

    e = F.col("target_5")
    rows = engineer_features(sig, 5, cfg)
    return rounded(rows.groupBy("series").agg(
        F.lit(5).alias("horizon"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.var_pop(e).alias("residual_variance"), F.count("*").alias("n"),
    ))


@query("latency_sweep", f"""WITH {_NAIVE}
SELECT series, 'Naive' AS model, latency, {r('sqrt(avg(residual * residual))', 'rmse')},
       {r('var_pop(residual)', 'precomp_variance')}, {r('var_pop(x)', 'input_variance')}
FROM t GROUP BY series, latency""")
def latency_sweep(spark, sf):
    """Variance left after pre-compensation against the input variance."""
    return rounded(pre.variance_reduction(naive_residuals(spark, sf), ["series"]))


@query("precompensated_power", f"""WITH {_NAIVE}
SELECT series, seq, latency, {r('x', 'level')}, {r('p', 'predicted_level')}, {r('residual', 'residual')} FROM t""")
def precompensated_power(spark, sf):
    return rounded(naive_residuals(spark, sf).drop("model"))


@query("residual_matrix", f"""WITH {_NAIVE}
SELECT series, seq, {', '.join(r(f"coalesce(max(residual) FILTER (latency = {h}), -9999)", f'latency_{h}') for h in SWEEP_LATENCIES)}
FROM t GROUP BY series, seq""")
def residual_matrix(spark, sf):
    """Residuals of all latencies aligned by sample; gaps are filled."""
    return rounded(pre.residual_matrix(naive_residuals(spark, sf), ["series"], SWEEP_LATENCIES))


@query("rmse_table", f"""WITH {_NAIVE}
SELECT series, latency, {r('sqrt(avg(residual * residual))', '"Naive"')} FROM t GROUP BY series, latency""")
def rmse_table(spark, sf):
    reduction = pre.variance_reduction(naive_residuals(spark, sf), ["series"])
    return rounded(pre.rmse_table(reduction, ["series"], ["Naive"]))


@query("prediction_alignment", f"""WITH {SIG}, p AS (
  SELECT series, seq, x, lag(x, 5) OVER ({W}) AS n5, lag(x, 50) OVER ({W}) AS n50 FROM sig)
SELECT series, seq, {r('x', 'actual')}, {r('n5', 'naive_5')}, {r('n50', 'naive_50')} FROM p WHERE n5 IS NOT NULL""")
def prediction_alignment(spark, sf):
    """Predictions that start at different samples, outer-joined by sample."""
    from linkcast.operators.windows import Targets, add_features

    both = add_features(db_signal(spark, sf), [Targets((5, 50), base="x")], keep=["x"])
    a = both.where("x_lag5 IS NOT NULL").select("series", "seq", F.col("x").alias("actual"), F.col("x_lag5").alias("naive_5"))
    b = both.where("x_lag50 IS NOT NULL").select("series", "seq", F.col("x_lag50").alias("naive_50"))
    return rounded(a.join(b, ["series", "seq"], "full_outer"))


_LN = "exp(-pow(ln({x}) + {v} / 2, 2) / (2 * {v})) / ({x} * sqrt({v} * 2 * pi()))"


@query("lognormal_density", f"""WITH {RAW}, f AS (SELECT series, seq, x / avg(x) OVER (PARTITION BY series) AS i FROM sig)
SELECT series, seq, {r(_LN.format(x='i', v='0.5::DOUBLE'), 'p')} FROM f""")
def lognormal_density(spark, sf):
    sig = raw_signal(spark, sf)
    mean = sig.df.groupBy("series").agg(F.avg("x").alias("m"))
    df = sig.attach(mean).withColumn("i", F.col("x") / F.col("m"))
    return rounded(df.select("series", "seq", lognormal_pdf(F.lit(0.5), F.col("i")).alias("p")))


_BINS, _STEPS = 200, 40


@query("lognormal_strength", f"""WITH {RAW},
f AS (SELECT series, x / avg(x) OVER ({W} ROWS BETWEEN 500 PRECEDING AND 499 FOLLOWING) AS i FROM sig),
span AS (SELECT series, min(i) AS lo, max(i) AS hi FROM f GROUP BY series),
b AS (SELECT f.series, lo, (hi - lo) / {_BINS} AS w,
        least(floor((i - lo) / ((hi - lo) / {_BINS})), {_BINS - 1}) AS bin FROM f JOIN span USING (series)),
n AS (SELECT series, bin, any_value(lo + bin * w) AS x, count(*) AS n FROM b GROUP BY series, bin),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY series) AS y FROM n QUALIFY y > 1e-6),
t AS (SELECT *, (lead(x) OVER o - x) * (lead(y) OVER o + y) / 2 AS area FROM s WINDOW o AS (PARTITION BY series ORDER BY bin)),
d AS (SELECT series, x, y / sum(area) OVER (PARTITION BY series) AS y FROM t),
g AS (SELECT i, 1e-4 * pow(20 / 1e-4, i / {_STEPS}::DOUBLE) AS v FROM range(0, {_STEPS + 1}) q(i)),
e AS (SELECT series, v, avg(pow({_LN.format(x='x', v='v')} - y, 2)) AS mse FROM d, g WHERE x > 0 GROUP BY series, v)
SELECT series, {r('arg_min(v, mse)', 'strength')}, {r('min(mse)', 'mse')} FROM e GROUP BY series""")
def lognormal_strength(spark, sf):
    """Best log-normal strength on a fixed grid (one search round)."""
    sig = raw_signal(spark, sf)
    hist = density(fast_fading(sig, "x"), ["series"], "fading", _BINS, n_groups=sig.n_series)
    return rounded(search(hist, ["series"], "lognormal", sig.n_series, rounds=1, steps=_STEPS))


@query("turbulence_strength")
def strength(spark, sf):
    """Gamma-gamma fit per link, log-normal where turbulence is weak."""
    return turbulence_strength(raw_signal(spark, sf), "x")
