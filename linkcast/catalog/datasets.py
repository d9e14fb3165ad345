"""Splits, scaling, prepared data sets and lookback windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkcast.catalog.common import CFG, SIG, W, back, db_signal, events, query, r, rounded
from linkcast.operators.sequences import (
    denormalize, label_sequences, make_sequences, normalize_sequences, sequence_split, sequence_stats,
)
from linkcast.operators.splits import apply_scaler, count_split, fit_scaler, ratio_split
from linkcast.operators.windows import Rolling, Targets, add_features
from linkcast.plans.dataset import prepare
from linkcast.plans.features import complete_rows, dropped_rows, horizon_view, wide_features

_FEATS = ["x_rolling_mean_5", "x_rolling_std_5", "x_rolling_max_20"]
_KEPT = f"""{SIG}, f AS (
  SELECT series, seq, x - lag(x, 5) OVER ({W}) AS target_5, lag(x, 5) OVER ({W}) AS x_lag5,
         avg(x) OVER {back(5)} AS x_rolling_mean_5, stddev_samp(x) OVER {back(5)} AS x_rolling_std_5,
         max(x) OVER {back(20)} AS x_rolling_max_20 FROM sig),
kept AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY series) AS n
         FROM f WHERE target_5 IS NOT NULL AND x_rolling_std_5 IS NOT NULL)"""
_SPLIT = f"""{_KEPT}, sp AS (
  SELECT *, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train'
                 WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM kept)"""


def _kept(sig):
    fams = [
        Rolling((5,), ("mean", "std"), base="x"), Rolling((20,), ("max",), base="x"),
        Targets((5,), base="x"),
    ]
    return complete_rows(add_features(sig, fams))


def _split(spark, sf, **kw):
    sig = db_signal(spark, sf)
    return sig, ratio_split(_kept(sig), ["series"], CFG.split, sig.n_series, **kw)


@query("ratio_split", f"WITH {_SPLIT} SELECT series, seq, split, {r('target_5', 'target_5')} FROM sp")
def split_by_ratio(spark, sf):
    _, df = _split(spark, sf, cell_rows=512)
    return rounded(df.select("series", "seq", "split", "target_5"))


@query("count_split", f"""WITH {_KEPT}
SELECT series, seq, CASE WHEN i < 1000 THEN 'train' ELSE 'test' END AS split FROM kept""")
def split_by_count(spark, sf):
    sig = db_signal(spark, sf)
    df = count_split(_kept(sig), ["series"], 1000, sig.n_series, cell_rows=512)
    return df.select("series", "seq", "split")


@query("gappy_split", f"""WITH {SIG}, kept AS (
  SELECT series, seq, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY series) AS n
  FROM sig WHERE x > 0)
SELECT series, seq, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM kept""")
def gappy_split(spark, sf):
    """A split over rows with gaps between their positions."""
    sig = db_signal(spark, sf)
    df = ratio_split(sig.df.where("x > 0"), ["series"], CFG.split, sig.n_series, cell_rows=256)
    return df.select("series", "seq", "split")


def _scaler_sql(center, scale):
    rows = " UNION ALL ".join(
        f"SELECT series, '{c}' AS feature, {center.format(c=c)} AS center, {scale.format(c=c)} AS scale "
        "FROM sp WHERE split = 'train' GROUP BY series" for c in _FEATS
    )
    return f"""WITH {_SPLIT}, s AS ({rows})
SELECT series, feature, {r('center', 'center')}, {r('CASE WHEN scale = 0 THEN 1 ELSE scale END', 'scale')} FROM s"""


_METHODS = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
}


def _register_scaler(method):
    @query(f"scaler_{method}", _scaler_sql(*_METHODS[method]))
    def fitted(spark, sf):
        _, df = _split(spark, sf)
        return rounded(fit_scaler(df, ["series"], _FEATS, method))


for _m in _METHODS:
    _register_scaler(_m)


@query("scaled_features", f"""WITH {_SPLIT}, st AS (
  SELECT series, {', '.join(f"avg({c}) FILTER (split = 'train') AS m{i}, stddev_pop({c}) FILTER (split = 'train') AS s{i}" for i, c in enumerate(_FEATS))}
  FROM sp GROUP BY series)
SELECT sp.series, seq, split, {', '.join(r(f'({c} - m{i}) / s{i}', c, 5) for i, c in enumerate(_FEATS))}
FROM sp JOIN st ON st.series = sp.series""")
def scaled_features(spark, sf):
    sig, df = _split(spark, sf)
    scaler = fit_scaler(df, ["series"], _FEATS)
    return rounded(apply_scaler(df, ["series"], _FEATS, scaler, sig.n_series).select("series", "seq", "split", *_FEATS), 5)


_LAGS = CFG.with_features(
    horizons=(5, 50), enable_rolling=False, enable_ema=False, enable_acf=False, enable_spectral=False,
    enable_trend=False, n_taps=3,
)


@query("dropped_rows", f"""WITH {SIG}
SELECT series, count(*) AS n_rows, count(*) FILTER (seq >= 53) AS n_kept, count(*) FILTER (seq < 53) AS n_dropped
FROM sig GROUP BY series""")
def count_dropped(spark, sf):
    sig = db_signal(spark, sf)
    return dropped_rows(horizon_view(wide_features(sig, _LAGS), ["series"], 50, _LAGS), ["series"])


def _prepared_sql(h):
    names = [f"x_diff_lag{k}" for k in range(h, h + 3)]
    stats = ", ".join(
        f"avg({c}) FILTER (split = 'train') AS m{i}, stddev_pop({c}) FILTER (split = 'train') AS s{i}"
        for i, c in enumerate(names)
    )
    cols = ", ".join(r(f"({c} - m{i}) / s{i}", f"tap{i}", 5) for i, c in enumerate(names))
    return f"""p{h} AS (
  SELECT series, seq, x, lag(x, {h}) OVER ({W}) AS level_lag, x - lag(x, {h}) OVER ({W}) AS y,
         {', '.join(f'lag(x, {k}) OVER ({W}) - lag(x, {k + 1}) OVER ({W}) AS x_diff_lag{k}' for k in range(h, h + 3))} FROM sig),
k{h} AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM p{h} WHERE x_diff_lag{h + 2} IS NOT NULL),
s{h} AS (SELECT *, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train'
           WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k{h}),
t{h} AS (SELECT series, {stats} FROM s{h} GROUP BY series),
o{h} AS (SELECT s.series, {h} AS horizon, seq, split, {cols}, {r('y', 'y', 5)} FROM s{h} s JOIN t{h} t ON t.series = s.series)"""


@query("prepared_dataset", f"""WITH {SIG}, {_prepared_sql(5)}, {_prepared_sql(50)}
SELECT * FROM o5 UNION ALL SELECT * FROM o50""")
def prepared_dataset(spark, sf):
    """Load, validate, features, split, scale and validate, for two horizons."""
    prep = prepare(events(spark, sf), "value", ["ts", "event_id"], ["series"], _LAGS)
    out = None
    for h, ds in prep.sets.items():
        taps = [F.col(c).alias(f"tap{i}") for i, c in enumerate(ds.features)]
        part = ds.df.select("series", F.lit(h).alias("horizon"), "seq", "split", *taps, "y")
        out = part if out is None else out.unionByName(part)
    return rounded(out, 5)


_LB, _H = 20, 10


@query("sequence_windows", f"""WITH {SIG}, w AS (
  SELECT series, seq, list(round(x, 6) + 0.0) OVER ({W} ROWS BETWEEN CURRENT ROW AND {_LB - 1} FOLLOWING) AS X,
         round(lead(x, {_LB + _H - 1}) OVER ({W}), 6) + 0.0 AS y FROM sig)
SELECT * FROM w WHERE y IS NOT NULL""")
def sequence_windows(spark, sf):
    df = make_sequences(rounded_signal(spark, sf), _LB, _H, False, "x")
    return df


def rounded_signal(spark, sf):
    sig = db_signal(spark, sf)
    return sig.with_df(rounded(sig.df))


@query("sequence_windows_ahead", f"""WITH {SIG}, w AS (
  SELECT series, seq, list(round(x, 6) + 0.0) OVER ({W} ROWS BETWEEN CURRENT ROW AND {_LB - 1} FOLLOWING) AS X,
         list(round(x, 6) + 0.0) OVER ({W} ROWS BETWEEN {_LB} FOLLOWING AND {_LB + _H - 1} FOLLOWING) AS y FROM sig)
SELECT * FROM w WHERE len(y) = {_H}""")
def sequence_windows_ahead(spark, sf):
    return make_sequences(rounded_signal(spark, sf), _LB, _H, True, "x")


_WIN = f"""{SIG}, nn AS (SELECT series, count(*) - {_LB + _H} + 1 AS n FROM sig GROUP BY series),
bnd AS (SELECT series, n, floor(n * 0.7::DOUBLE) AS v, floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) AS t FROM nn),
el AS (SELECT a.series, b.x FROM sig a JOIN bnd ON bnd.series = a.series AND a.seq < bnd.v
       JOIN sig b ON b.series = a.series AND b.seq BETWEEN a.seq AND a.seq + {_LB - 1}),
st AS (SELECT series, avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo, max(x) - min(x) AS rg FROM el GROUP BY series)"""


@query("sequence_split", f"""WITH {_WIN}
SELECT sig.series, seq, CASE WHEN seq < v THEN 'train' WHEN seq < t THEN 'val' ELSE 'test' END AS split
FROM sig JOIN bnd ON bnd.series = sig.series WHERE seq < n""")
def split_sequences(spark, sf):
    sig = db_signal(spark, sf)
    bounds = sequence_split(sig, _LB, _H)
    windows = make_sequences(sig, _LB, _H, False, "x")
    return label_sequences(windows, bounds, ["series"], sig.n_series).select("series", "seq", "split")


@query("sequence_statistics", f"""WITH {_WIN}
SELECT series, {r('m', 'mean')}, {r('s', 'std')}, {r('lo', 'low')}, {r('rg', 'width')} FROM st""")
def sequence_statistics(spark, sf):
    sig = db_signal(spark, sf)
    bounds = sequence_split(sig, _LB, _H)
    std = sequence_stats(sig, bounds, _LB, "standard", "x").withColumnsRenamed({"center": "mean", "scale": "std"})
    rng = sequence_stats(sig, bounds, _LB, "minmax", "x").withColumnsRenamed({"center": "low", "scale": "width"})
    return rounded(std.join(rng, "series"))


@query("sequence_normalised", f"""WITH {_WIN}, w AS (
  SELECT series, seq, list(x) OVER ({W} ROWS BETWEEN CURRENT ROW AND {_LB - 1} FOLLOWING) AS xs,
         lead(x, {_LB + _H - 1}) OVER ({W}) AS y FROM sig)
SELECT w.series, seq, {r('(xs[1] - m) / s', 'first', 5)}, {r(f'(xs[{_LB}] - m) / s', 'last', 5)},
       {r(f'list_sum(xs) / {_LB}', 'mean_restored', 5)}
FROM w JOIN st ON st.series = w.series WHERE y IS NOT NULL""")
def sequence_normalised(spark, sf):
    """Normalised windows and the way back to signal units."""
    sig = db_signal(spark, sf)
    stats = sequence_stats(sig, sequence_split(sig, _LB, _H), _LB, "standard", "x")
    norm = normalize_sequences(make_sequences(sig, _LB, _H, False, "x"), stats, ["series"], sig.n_series)
    back_again = denormalize(norm.withColumn("Z", F.col("X")), stats, ["series"], sig.n_series, "Z")
    mean = F.aggregate("Z", F.lit(0.0), lambda a, v: a + v) / _LB
    return rounded(back_again.select(
        "series", "seq", F.col("X")[0].alias("first"), F.col("X")[_LB - 1].alias("last"),
        mean.alias("mean_restored"),
    ), 5)
