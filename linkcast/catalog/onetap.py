"""Forecasters on the newest difference alone: least squares that SQL can check.

The same functions as in ``models`` (fit, results, matrix, scoring, sweep), through the same
forecaster, with one feature, so that slope and intercept are aggregates.
"""

from __future__ import annotations

from dataclasses import replace

from linkcast.catalog.common import CFG, SIG, db_signal, events, query, r, rounded
from linkcast.config import SWEEP_LATENCIES
from linkcast.plans import forecast as fc
from linkcast.plans import precompensation as pre
from linkcast.plans import reports
from linkcast.plans.dataset import prepare

HORIZONS = (5, 50, 100)
ONE = CFG.with_features(
    horizons=HORIZONS, availability="asof", n_taps=1, enable_rolling=False, enable_ema=False, enable_acf=False,
    enable_spectral=False, enable_trend=False,
)
N_TRAIN = 100
RESULT = (
    "model_name", "horizon", "train_rmse", "val_rmse", "test_rmse", "test_mae", "test_r2", "residual_variance",
    "pred_variance", "model_complexity", "n_train_samples", "n_test_samples",
)

_ROWS = f"""{SIG},
h AS (SELECT * FROM (VALUES {', '.join(f'({h})' for h in HORIZONS)}) v(horizon)),
t AS (SELECT series, horizon, seq, x, lead(x, horizon) OVER w - x AS y, x - lag(x) OVER w AS f
      FROM sig, h WINDOW w AS (PARTITION BY series, horizon ORDER BY seq)),
k AS (SELECT *, row_number() OVER (PARTITION BY series, horizon ORDER BY seq) - 1 AS i,
             count(*) OVER (PARTITION BY series, horizon) AS n FROM t WHERE y IS NOT NULL AND f IS NOT NULL),
s AS (SELECT *, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train'
                     WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k),
m AS (SELECT horizon, regr_slope(y, f) AS a, regr_intercept(y, f) AS b FROM s WHERE split = 'train' GROUP BY horizon)"""


def _judged(model: str, prediction: str, size: int) -> str:
    e = f"(y - ({prediction}))"
    return f"""SELECT '{model}' AS model_name, horizon,
       {r(f"sqrt(avg({e} * {e}) FILTER (split = 'train'))", 'train_rmse')}, {r(f"sqrt(avg({e} * {e}) FILTER (split = 'val'))", 'val_rmse')},
       {r(f"sqrt(avg({e} * {e}) FILTER (split = 'test'))", 'test_rmse')}, {r(f"avg(abs({e})) FILTER (split = 'test')", 'test_mae')},
       {r(f"1 - sum({e} * {e}) FILTER (split = 'test') / (var_pop(y) FILTER (split = 'test') * count(*) FILTER (split = 'test'))", 'test_r2')},
       {r(f"var_pop({e}) FILTER (split = 'test')", 'residual_variance')},
       {r(f"var_pop(({prediction})::DOUBLE) FILTER (split = 'test')", 'pred_variance')}, {size}::BIGINT AS model_complexity,
       count(*) FILTER (split = 'train') AS n_train_samples, count(*) FILTER (split = 'test') AS n_test_samples
FROM s JOIN m USING (horizon) GROUP BY horizon"""


def one_tap_sets(spark, sf):
    cfg = replace(ONE, scaling=None)
    return prepare(events(spark, sf), "value", ["ts", "event_id"], ["series"], cfg, check=False).sets


@query("one_tap_horizons", f"WITH {_ROWS} {_judged('Linear Regression', 'a * f + b', 2)}")
def one_tap_horizons(spark, sf):
    """A linear model per horizon and its results."""
    done = fc.train_horizons(one_tap_sets(spark, sf), "linear", HORIZONS)
    return rounded(reports.append_results([row for _, row, _ in done.values()]).select(*RESULT))


@query("one_tap_matrix", f"WITH {_ROWS} {_judged('Linear Regression', 'a * f + b', 2)} UNION ALL {_judged('Naive', '0.0', 0)}")
def one_tap_matrix(spark, sf):
    """Linear and naive model on every horizon."""
    return rounded(reports.evaluation_matrix(one_tap_sets(spark, sf), {"naive": {}, "linear": {}}).select(*RESULT))


@query("one_tap_scoring", f"""WITH {_ROWS} SELECT series, seq + 5 AS seq, {r('x + y', 'level')},
       {r('a * f + b + x', 'predicted_level')}, {r('y - a * f - b', 'residual')}
FROM s JOIN m USING (horizon) WHERE split = 'test' AND horizon = 5""")
def one_tap_scoring(spark, sf):
    """Predicted levels of the test rows."""
    ds = one_tap_sets(spark, sf)[5]
    scored = fc.scored_levels(fc.fit("linear", ds).score(ds.part("test")))
    return rounded(scored.select("series", "seq", "level", "predicted_level", "residual"))


_SWEEP = f"""{SIG},
h AS (SELECT * FROM (VALUES {', '.join(f'({h})' for h in SWEEP_LATENCIES)}) v(latency)),
t AS (SELECT series, latency, seq, x AS level, lag(x, latency) OVER w AS last, x - lag(x, latency) OVER w AS y,
             lag(x, latency) OVER w - lag(x, latency + 1) OVER w AS f
      FROM sig, h WINDOW w AS (PARTITION BY series, latency ORDER BY seq)),
k AS (SELECT *, row_number() OVER (PARTITION BY series, latency ORDER BY seq) - 1 AS i FROM t WHERE f IS NOT NULL),
m AS (SELECT latency, regr_slope(y, f) AS a, regr_intercept(y, f) AS b FROM k WHERE i < {N_TRAIN} GROUP BY latency),
e AS (SELECT *, y - a * f - b AS e FROM k JOIN m USING (latency) WHERE i >= {N_TRAIN})"""


def _residuals(spark, sf, latencies):
    sig = db_signal(spark, sf)
    rows = pre.sweep_rows(sig, latencies, N_TRAIN, ONE.with_features(availability="current"))
    sets = pre.sweep_sets(rows, sig, latencies, ONE.with_features(availability="current"))
    return pre.naive_residuals(rows, ["series"]).unionByName(pre.sweep_residuals(sets, {"linear": {}}))


@query("one_tap_sweep", f"""WITH {_SWEEP}, b AS (
  SELECT 'Linear Regression' AS model, series, latency, e, level FROM e UNION ALL SELECT 'Naive', series, latency, y, level FROM e)
SELECT series, model, latency, {r('sqrt(avg(e * e))', 'rmse')}, {r('var_pop(e)', 'precomp_variance')}, {r('var_pop(level)', 'input_variance')}
FROM b GROUP BY series, model, latency""")
def one_tap_sweep(spark, sf):
    """Power left after pre-compensation at every latency, with a trained and the naive model."""
    return rounded(pre.variance_reduction(_residuals(spark, sf, SWEEP_LATENCIES), ["series"]))


@query("one_tap_predictions", f"""WITH {_SWEEP} SELECT series, seq, {r('level', 'actual')}, {r('last', 'Naive')},
       {r('last + a * f + b', '"Linear Regression"')} FROM e WHERE latency = 5""")
def one_tap_predictions(spark, sf):
    """The actual level next to the two predictions."""
    return rounded(pre.prediction_table(_residuals(spark, sf, (5,)), ["series"], 5, ["Naive", "Linear Regression"]))


@query("one_tap_importance", f"WITH {_ROWS} SELECT 'Linear Regression' AS model, horizon, 'x_diff_lag' || horizon AS feature, {r('a', 'importance')}, 1 AS rank FROM m")
def one_tap_importance(spark, sf):
    """The weight of the only feature, per horizon."""
    out = None
    for h, ds in one_tap_sets(spark, sf).items():
        part = fc.importance(fc.fit("linear", ds), h, spark)
        out = part if out is None else out.unionByName(part)
    return rounded(out)
