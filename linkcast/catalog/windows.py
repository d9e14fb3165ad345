"""Ordered-window features."""

from __future__ import annotations

from linkcast.catalog.common import CFG, RAW, SIG, SQL, W, PRICE, back, db_signal, price_signal, query, r, raw_signal, rounded
from linkcast.operators.spectrum import Spectrum
from linkcast.operators.windows import (
    Diff, Ema, FastFading, Lags, Rolling, RollingAcf, Targets, Trend, add_features, moving_average, slow_ema,
)
from linkcast.plans.features import (
    complete_rows, engineer_features, horizon_view, long_form, wide_features,
)

_DIFFS = ", ".join(
    r(f"lag(x, {k}) OVER ({W}) - lag(x, {k + 1}) OVER ({W})", f"x_diff_lag{k}") for k in range(5, 15)
)


@query("lagged_differences", f"WITH {SIG} SELECT series, seq, {_DIFFS} FROM sig")
def lagged_differences(spark, sf):
    return rounded(add_features(db_signal(spark, sf), [Lags(tuple(range(5, 15)), True, "x")]))


@query("lagged_levels", f"WITH {SIG} SELECT series, seq, "
       + ", ".join(r(f"lag(x, {k}) OVER ({W})", f"x_lag{k}") for k in range(5, 15)) + " FROM sig")
def lagged_levels(spark, sf):
    return rounded(add_features(db_signal(spark, sf), [Lags(tuple(range(5, 15)), False, "x")]))


_AGG = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
_ROLL = ", ".join(
    r(f"{fn}(x) OVER {back(w)}", f"x_rolling_{s}_{w}", 5) for w in (5, 10, 20, 50) for s, fn in _AGG.items()
)


@query("rolling_statistics", f"WITH {SIG} SELECT series, seq, {_ROLL} FROM sig")
def rolling_statistics(spark, sf):
    return rounded(add_features(db_signal(spark, sf), [Rolling(base="x")]), 5)


@query("rolling_statistics_prices", f"WITH {PRICE} SELECT series, seq, "
       + ", ".join(r(f"{fn}(x) OVER {back(20)}", f"x_rolling_{s}_20", 4) for s, fn in _AGG.items() if s != "mean")
       + " FROM sig")
def rolling_statistics_prices(spark, sf):
    """Order with many ties in the leading column."""
    return rounded(add_features(price_signal(spark, sf), [Rolling((20,), ("std", "min", "max"), base="x")]), 4)


def _full(col, w, name):
    return r(f"CASE WHEN count({col}) OVER {back(w)} >= {w} THEN avg({col}) OVER {back(w)} END", name)


@query("rolling_mean_full", f"""WITH {SIG}, d AS (SELECT *, x - lag(x) OVER ({W}) AS x_diff FROM sig)
SELECT series, seq, {', '.join(_full('x', w, f'x_rolling_mean_{w}') for w in (5, 10, 20))},
       {', '.join(_full('x_diff', w, f'x_diff_rolling_mean_{w}') for w in (5, 10, 20))} FROM d""")
def rolling_mean_full(spark, sf):
    """Full windows only, on the level and on its first difference."""
    sig = db_signal(spark, sf)
    diff = sig.with_df(add_features(sig, [Diff("x")], keep=["x"]))
    fams = [Rolling((5, 10, 20), ("mean",), None, c) for c in ("x", "x_diff")]
    return rounded(add_features(diff, fams))


@query("moving_average", f"WITH {SIG} SELECT series, seq, {r(f'avg(x) OVER {back(20)}', 'x_rolling_mean_20')} FROM sig")
def moving_average_20(spark, sf):
    return rounded(add_features(db_signal(spark, sf), [moving_average(20, "x")]))




@query("exponential_average", f"""WITH RECURSIVE {SIG}, m AS MATERIALIZED (SELECT * FROM sig),
e AS (
  SELECT series, seq, x AS e1, x AS e3, x AS e5 FROM m WHERE seq = 0
  UNION ALL
  SELECT m.series, m.seq, 0.9 * e1 + 0.1 * m.x, 0.7 * e3 + 0.3 * m.x, 0.5 * e5 + 0.5 * m.x
  FROM e JOIN m ON m.series = e.series AND m.seq = e.seq + 1)
SELECT series, seq, {r('e1', 'x_ema_0_1')}, {r('e3', 'x_ema_0_3')}, {r('e5', 'x_ema_0_5')} FROM e""")
def exponential_average(spark, sf):
    return rounded(add_features(db_signal(spark, sf), [Ema(base="x")]))


@query("exponential_average_weighted", f"""WITH RECURSIVE {SIG}, m AS MATERIALIZED (SELECT * FROM sig),
e AS (
  SELECT series, seq, x AS n1, 1.0::DOUBLE AS d1, x AS n5, 1.0::DOUBLE AS d5 FROM m WHERE seq = 0
  UNION ALL
  SELECT m.series, m.seq, 0.9 * n1 + m.x, 0.9 * d1 + 1, 0.5 * n5 + m.x, 0.5 * d5 + 1
  FROM e JOIN m ON m.series = e.series AND m.seq = e.seq + 1)
SELECT series, seq, {r('n1 / d1', 'x_ema_0_1')}, {r('n5 / d5', 'x_ema_0_5')} FROM e""")
def exponential_average_weighted(spark, sf):
    return rounded(add_features(db_signal(spark, sf), [Ema((0.1, 0.5), True, "x")]))


@query("exponential_average_slow", f"""WITH RECURSIVE {SIG}, m AS MATERIALIZED (SELECT * FROM sig),
e AS (
  SELECT series, seq, x AS e1, x AS e2 FROM m WHERE seq = 0
  UNION ALL
  SELECT m.series, m.seq, 0.999 * e1 + 0.001 * m.x, 0.98 * e2 + 0.02 * m.x
  FROM e JOIN m ON m.series = e.series AND m.seq = e.seq + 1)
SELECT series, seq, {r('e1', 'x_ema_0_001')}, {r('e2', 'x_ema_0_02')} FROM e""")
def exponential_average_slow(spark, sf):
    """Small factors: sums of runs are carried over many later runs."""
    return rounded(slow_ema(db_signal(spark, sf), (0.001, 0.02), False, "x", 256).drop("x"))


def _acf_sql(mode):
    cols = []
    for k in (1, 5, 10, 20):
        lo, hi = 100, k + 1
        if mode == "wrapped":
            pairs = (
                f"list_concat(w[101 - {k}:100], w[1:100 - 2 * {k}])", f"w[1:100 - {k}]"
            )
        else:
            pairs = (f"w[1:100 - {k}]", f"w[{k} + 1:100]")
        cols.append((k, *pairs))
    parts = ", ".join(f"{a} AS a{k}, {b} AS b{k}" for k, a, b in cols)
    dev = ", ".join(
        f"list_transform(a{k}, lambda v: v - list_avg(a{k})) AS p{k}, "
        f"list_transform(b{k}, lambda v: v - list_avg(b{k})) AS q{k}" for k, _, _ in cols
    )
    corr = ", ".join(
        r(f"CASE WHEN seq < 100 THEN 0 ELSE list_inner_product(p{k}, q{k}) / "
          f"sqrt(list_inner_product(p{k}, p{k}) * list_inner_product(q{k}, q{k})) END", f"x_acf_lag{k}")
        for k, _, _ in cols
    )
    return f"""WITH {SIG}, win AS (
  SELECT series, seq, list(x) OVER ({W} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS w FROM sig),
ab AS (SELECT series, seq, {parts} FROM win), pq AS (SELECT series, seq, {dev} FROM ab)
SELECT series, seq, {corr} FROM pq"""


@query("rolling_autocorrelation", _acf_sql("wrapped"))
def rolling_autocorrelation(spark, sf):
    return rounded(add_features(db_signal(spark, sf), [RollingAcf(base="x")]))


@query("rolling_autocorrelation_valid", _acf_sql("valid"))
def rolling_autocorrelation_valid(spark, sf):
    return rounded(add_features(db_signal(spark, sf), [RollingAcf(mode="valid", base="x")]))


_TOP = ", ".join(
    f"{r(f'f[{i}]', f'x_spectral_freq{i}', 2)}, {r(f'p[{i}]', f'x_spectral_power{i}', 2)}" for i in range(1, 6)
)


@query("rolling_spectrum", f"""WITH {SIG},
taps AS (
  SELECT k, j, (0.5 - 0.5 * cos(2 * pi() * j / 99)) * cos(2 * pi() * k * j / 100) AS c,
         (0.5 - 0.5 * cos(2 * pi() * j / 99)) * sin(2 * pi() * k * j / 100) AS s
  FROM range(0, 51) a(k), range(0, 100) b(j)),
filt AS (SELECT k, list(c ORDER BY j) AS c, list(s ORDER BY j) AS s FROM taps GROUP BY k),
win AS (
  SELECT series, seq, list(x) OVER ({W} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS w FROM sig),
bins AS (
  SELECT series, seq, k, pow(list_inner_product(w, c), 2) + pow(list_inner_product(w, s), 2) AS p
  FROM (SELECT * FROM win WHERE seq >= 100) t, filt),
spec AS (
  SELECT series, seq, sum(p) AS total, sum(p * k * 100) / sum(p) AS centroid,
         list(k * 100::DOUBLE ORDER BY p DESC, k) AS f, list(p ORDER BY p DESC, k) AS p
  FROM bins GROUP BY series, seq)
SELECT s.series, s.seq, {r('total', 'x_spectral_power_total', 2)}, {r('centroid', 'x_spectral_centroid', 2)}, {_TOP}
FROM sig s LEFT JOIN spec ON spec.series = s.series AND spec.seq = greatest(s.seq, 100)""")
def rolling_spectrum(spark, sf):
    return rounded(add_features(db_signal(spark, sf), [], Spectrum(base="x")), 2)


_CENTRED = f"({W} ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)"


@query("trend", f"WITH {SIG} SELECT series, seq, {r(f'avg(x) OVER {_CENTRED}', 'x_trend')} FROM sig")
def trend(spark, sf):
    return rounded(add_features(db_signal(spark, sf), [Trend(base="x")]).drop("x_residual", "x_residual_std"))


@query("trend_residual", f"""WITH {SIG},
t AS (SELECT *, avg(x) OVER {_CENTRED} AS x_trend FROM sig),
e AS (SELECT *, x - x_trend AS res FROM t)
SELECT series, seq, {r('x_trend', 'x_trend')}, {r('res', 'x_residual')},
       {r(f'stddev_samp(res) OVER {back(50)}', 'x_residual_std')} FROM e""")
def trend_residual(spark, sf):
    return rounded(add_features(db_signal(spark, sf), [Trend(base="x")]))


@query("horizon_target", f"""WITH {SIG}
SELECT series, seq, {r(f'lag(x, 5) OVER ({W})', 'x_lag5')}, {r(f'x - lag(x, 5) OVER ({W})', 'target_5')} FROM sig""")
def horizon_target(spark, sf):
    return rounded(add_features(db_signal(spark, sf), [Targets((5,), base="x")]))


@query("fast_fading", f"""WITH {RAW}
SELECT series, seq, {r(f'x / avg(x) OVER ({W} ROWS BETWEEN 500 PRECEDING AND 499 FOLLOWING)', 'x_fading')} FROM sig""")
def fast_fading(spark, sf):
    return rounded(add_features(raw_signal(spark, sf), [FastFading(1000, "x")]))


_SHARED = f"""{SIG}, t1 AS (
  SELECT *, x - lag(x) OVER ({W}) AS x_diff, avg(x) OVER {_CENTRED} AS x_trend,
         {', '.join(f'{fn}(x) OVER {back(w)} AS x_rolling_{s}_{w}' for w in (5, 10, 20, 50) for s, fn in _AGG.items())}
  FROM sig),
t2 AS (SELECT *, x - x_trend AS x_residual FROM t1),
feat AS (SELECT *, stddev_samp(x_residual) OVER {back(50)} AS x_residual_std FROM t2)"""
_SHARED_NAMES = [f"x_rolling_{s}_{w}" for w in (5, 10, 20, 50) for s in _AGG] + [
    "x_trend", "x_residual", "x_residual_std",
]
FRAMES_ONLY = CFG.with_features(horizons=(5, 50), enable_ema=False, enable_acf=False, enable_spectral=False)


@query("feature_set", f"""WITH {_SHARED}, lagged AS (
  SELECT *, {', '.join(f'lag(x_diff, {k}) OVER ({W}) AS x_diff_lag{k}' for k in range(5, 15))},
         lag(x, 5) OVER ({W}) AS x_lag5, x - lag(x, 5) OVER ({W}) AS target_5 FROM feat)
SELECT series, seq, {', '.join(r(c, c, 5) for c in
    ['x', 'x_diff', *[f'x_diff_lag{k}' for k in range(5, 15)], *_SHARED_NAMES, 'x_lag5', 'target_5'])}
FROM lagged WHERE x_diff_lag14 IS NOT NULL AND x_rolling_std_5 IS NOT NULL""")
def feature_set(spark, sf):
    """Lags, frames, trend and target of one horizon; incomplete rows dropped."""
    return rounded(engineer_features(db_signal(spark, sf), 5, FRAMES_ONLY), 5)


_PARTS = ("exponential_average", "rolling_autocorrelation", "rolling_spectrum")


@query("feature_set_all", f"SELECT * FROM ({SQL['feature_set']}) base "
       + " ".join(f"JOIN ({SQL[n]}) {n} USING (series, seq)" for n in _PARTS))
def feature_set_all(spark, sf):
    """All six families: 48 features of one horizon."""
    df = engineer_features(db_signal(spark, sf), 5, CFG)
    finer = {c: 6 for c in df.columns if "_ema_" in c or "_acf_" in c}
    coarser = {c: 2 for c in df.columns if "_spectral_" in c}
    return rounded(df, 5, **finer, **coarser)


@query("feature_set_prices")
def feature_set_prices(spark, sf):
    """The same 48 features for many shorter series with ties in time."""
    return engineer_features(price_signal(spark, sf), 5, CFG)


_TAPS = ", ".join(
    r(f"lag(x_diff, h.horizon + {i}) OVER (PARTITION BY series, h.horizon ORDER BY seq)", f"tap{i}", 5)
    for i in range(10)
)


@query("multi_horizon_features", f"""WITH {_SHARED}
SELECT series, seq, h.horizon, {', '.join(r(c, c, 5) for c in ['x', *_SHARED_NAMES])}, {_TAPS},
       {r('lag(x, h.horizon) OVER (PARTITION BY series, h.horizon ORDER BY seq)', 'level_lag', 5)},
       {r('x - lag(x, h.horizon) OVER (PARTITION BY series, h.horizon ORDER BY seq)', 'target', 5)}
FROM feat, (VALUES (5), (50)) h(horizon)""")
def multi_horizon_features(spark, sf):
    """Two horizons stacked; features that do not depend on it are computed once."""
    sig = db_signal(spark, sf)
    return rounded(long_form(wide_features(sig, FRAMES_ONLY), ["series"], FRAMES_ONLY), 5)


_ASOF = FRAMES_ONLY.with_features(availability="asof")
_LAG = f"OVER ({W})"


@query("features_asof", f"""WITH {SIG}, t1 AS (
  SELECT *, x - lag(x) OVER ({W}) AS x_diff, avg(x) OVER {back(50)} AS x_trend,
         {', '.join(f'{fn}(x) OVER {back(w)} AS x_rolling_{s}_{w}' for w in (5, 10, 20, 50) for s, fn in _AGG.items())}
  FROM sig),
t2 AS (SELECT *, x - x_trend AS x_residual FROM t1),
feat AS (SELECT *, stddev_samp(x_residual) OVER {back(50)} AS x_residual_std FROM t2),
sh AS (SELECT series, seq, x, {', '.join(f'lag({c}, 50) {_LAG} AS {c}' for c in _SHARED_NAMES)},
         {', '.join(f'lag(x_diff, {50 + i}) {_LAG} AS x_diff_lag{50 + i}' for i in range(10))},
         lag(x, 50) {_LAG} AS x_lag50, x - lag(x, 50) {_LAG} AS target_50 FROM feat)
SELECT series, seq, {', '.join(r(c, c, 5) for c in
    ['x', *[f'x_diff_lag{50 + i}' for i in range(10)], *_SHARED_NAMES, 'x_lag50', 'target_50'])}
FROM sh WHERE x_diff_lag59 IS NOT NULL AND x_rolling_std_5 IS NOT NULL""")
def features_asof(spark, sf):
    """Only values known when the forecast is made."""
    sig = db_signal(spark, sf)
    view = horizon_view(wide_features(sig, _ASOF), ["series"], 50, _ASOF)
    return rounded(complete_rows(view), 5)
