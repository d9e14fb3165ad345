"""Aggregates, exploratory statistics and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkcast.catalog.common import (
    BASELINE_ROWS, CFG, RAW, RESULTS, SIG, W, back, baseline_results, baseline_rows, db_signal,
    events, query, r, raw_signal, rounded,
)
from linkcast.functions.scalar import pearson
from linkcast.operators.quantiles import quantiles
from linkcast.operators.stats import (
    autocorrelation, density, describe, histogram, outliers, qq_points, quality_counts,
    normal_quantile, target_correlation, variance_ranking,
)
from linkcast.operators.windows import Rolling, Targets, add_features
from linkcast.plans.forecast import metrics
from linkcast.plans.reports import model_means, spread_by_model, stability
from linkcast.sources.signals import load_signal

BY = ["series", "model_name", "horizon", "split"]


@query("regression_metrics", f"""WITH {BASELINE_ROWS}, err AS (SELECT *, y - prediction AS e FROM scored)
SELECT series, model_name, horizon, split, {r('sqrt(avg(e * e))', 'rmse')}, {r('avg(abs(e))', 'mae')},
       {r('avg(e * e)', 'mse')}, {r('1 - sum(e * e) / (var_pop(y) * count(*))', 'r2')},
       {r('var_pop(e)', 'residual_variance')}, {r('var_pop(prediction)', 'pred_variance')},
       {r('var_pop(y)', 'target_variance')}, count(*) AS n
FROM err GROUP BY series, model_name, horizon, split""")
def regression_metrics(spark, sf):
    return rounded(metrics(baseline_rows(spark, sf), BY))


@query("residual_variance", f"""WITH {BASELINE_ROWS}
SELECT model_name, horizon, {r('var_pop(y - prediction)', 'residual_variance')}
FROM scored WHERE split = 'test' GROUP BY model_name, horizon""")
def residual_variance(spark, sf):
    rows = baseline_rows(spark, sf).where("split = 'test'")
    e = F.col("y") - F.col("prediction")
    return rounded(rows.groupBy("model_name", "horizon").agg(F.var_pop(e).alias("residual_variance")))


@query("split_variances", f"""WITH {BASELINE_ROWS}
SELECT model_name, horizon,
       {r("var_pop(prediction) FILTER (split = 'test')", 'pred_variance')},
       {r("var_pop(y) FILTER (split = 'test')", 'target_variance')},
       {r("var_pop(y - prediction) FILTER (split = 'train')", 'precomp_variance_train')}
FROM scored GROUP BY model_name, horizon""")
def split_variances(spark, sf):
    y, p = F.col("y"), F.col("prediction")
    on = lambda s, c: F.when(F.col("split") == s, c)
    return rounded(baseline_rows(spark, sf).groupBy("model_name", "horizon").agg(
        F.var_pop(on("test", p)).alias("pred_variance"),
        F.var_pop(on("test", y)).alias("target_variance"),
        F.var_pop(on("train", y - p)).alias("precomp_variance_train"),
    ))


@query("model_means", f"""WITH {RESULTS}
SELECT model_name, {r('avg(test_rmse)', 'avg_rmse')}, {r('avg(test_mae)', 'avg_mae')},
       {r('avg(test_r2)', 'avg_r2')}, {r('avg(training_time)', 'avg_training_time')},
       {r('avg(inference_time_per_sample_ms)', 'avg_inference_time_ms')} FROM res GROUP BY model_name""")
def means(spark, sf):
    return rounded(model_means(baseline_results(spark, sf)))


@query("model_spread", f"""WITH {RESULTS}
SELECT model_name, {r('avg(test_rmse)', 'mean')}, {r('min(test_rmse)', 'min')}, {r('max(test_rmse)', 'max')}
FROM res GROUP BY model_name""")
def spread(spark, sf):
    return rounded(spread_by_model(baseline_results(spark, sf)))


@query("model_stability", f"""WITH {RESULTS}
SELECT model_name, {r('stddev_samp(test_rmse)', 'rmse_std')} FROM res GROUP BY model_name
ORDER BY stddev_samp(test_rmse), model_name LIMIT 1""")
def most_stable(spark, sf):
    """The smallest deviation over the horizons."""
    steady = stability(baseline_results(spark, sf)).orderBy("rmse_std", "model_name").limit(1)
    return rounded(steady)


@query("distinct_models", f"""WITH {BASELINE_ROWS}
SELECT count(DISTINCT model_name) AS n_models, count(DISTINCT horizon) AS n_horizons, count(*) AS n_rows FROM scored""")
def distinct_models(spark, sf):
    return baseline_rows(spark, sf).agg(
        F.count_distinct("model_name").alias("n_models"),
        F.count_distinct("horizon").alias("n_horizons"),
        F.count("*").alias("n_rows"),
    )


_Q = ", ".join(r(f"quantile_cont(x, {p})", n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))


@query("describe", f"""WITH {SIG}
SELECT series, 'x' AS name, count(x) AS count, {r('avg(x)', 'mean')}, {r('stddev_samp(x)', 'std')},
       {r('min(x)', 'min')}, {_Q}, {r('max(x)', 'max')} FROM sig GROUP BY series""")
def describe_signal(spark, sf):
    return rounded(describe(db_signal(spark, sf).df, ["series"], ["x"]))


_FEATS = [f"x_rolling_{s}_{w}" for w in (5, 20, 50) for s in ("mean", "std", "min", "max")]
_AGG = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
_FEAT_SQL = f"""{SIG}, feat AS (SELECT series, seq, x, x - lag(x, 5) OVER ({W}) AS target_5,
  {', '.join(f'{fn}(x) OVER {back(w)} AS x_rolling_{s}_{w}' for w in (5, 20, 50) for s, fn in _AGG.items())} FROM sig)"""


def _features(spark, sf):
    fams = [Rolling((5, 20, 50), base="x"), Targets((5,), base="x")]
    return add_features(db_signal(spark, sf), fams, keep=["x"])


@query("variance_ranking", f"""WITH {_FEAT_SQL}, v AS ({' UNION ALL '.join(
    f"SELECT series, '{c}' AS feature, var_samp({c}) AS variance FROM feat GROUP BY series" for c in _FEATS)}),
rk AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY variance DESC, feature) AS rank FROM v)
SELECT series, feature, {r('variance', 'variance', 5)}, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 10""")
def variance_rank(spark, sf):
    return rounded(variance_ranking(_features(spark, sf), ["series"], _FEATS, 10), 5)


@query("target_correlation", f"""WITH {_FEAT_SQL}, v AS ({' UNION ALL '.join(
    f"SELECT series, '{c}' AS feature, abs(corr({c}, target_5)) AS correlation FROM feat GROUP BY series" for c in _FEATS)})
SELECT series, feature, {r('correlation', 'correlation')},
       CAST(row_number() OVER (PARTITION BY series ORDER BY correlation DESC, feature) AS INT) AS rank FROM v""")
def target_correlations(spark, sf):
    return rounded(target_correlation(_features(spark, sf), ["series"], _FEATS, "target_5"))


_BOUNDS = f"""{SIG}, q AS (SELECT series, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM sig GROUP BY series),
b AS (SELECT *, q3 - q1 AS iqr, q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM q)"""
_OUT = f"""WITH {_BOUNDS}
SELECT series, {r('any_value(q1)', 'q1')}, {r('any_value(q3)', 'q3')}, {r('any_value(iqr)', 'iqr')},
       {r('any_value(lo)', 'lower_bound')}, {r('any_value(hi)', 'upper_bound')},
       count(*) FILTER (x < lo OR x > hi) AS n_outliers,
       {r('count(*) FILTER (x < lo OR x > hi) / count(*) * 100', 'outlier_pct')}
FROM sig JOIN b USING (series) GROUP BY series"""


@query("outliers", _OUT)
def iqr_outliers(spark, sf):
    sig = db_signal(spark, sf)
    return rounded(outliers(sig.df, ["series"], "x", n_groups=sig.n_series))


@query("outliers_ranked", _OUT)
def iqr_outliers_ranked(spark, sf):
    """Quartiles by a range sort, as used for groups of any size."""
    sig = db_signal(spark, sf)
    return rounded(outliers(sig.df, ["series"], "x", n_groups=sig.n_series, short_group=0))


@query("autocorrelation", f"""WITH {SIG}, p AS (
  SELECT a.series, k AS lag, corr(a.x, b.x) AS c FROM sig a, range(1, 100) t(k)
  JOIN sig b ON b.series = a.series AND b.seq = a.seq + k GROUP BY a.series, k
  UNION ALL SELECT series, 0, 1.0 FROM sig GROUP BY series)
SELECT p.series, CAST(lag AS INT) AS lag, {r('c', 'acf')}, {r('1.96 / sqrt(n)', 'band')}
FROM p JOIN (SELECT series, count(*) AS n FROM sig GROUP BY series) s ON s.series = p.series""")
def global_autocorrelation(spark, sf):
    return rounded(autocorrelation(db_signal(spark, sf), "x"))


_HIST = """span AS (SELECT series, min(x) AS lo, max(x) AS hi FROM sig GROUP BY series),
h AS (SELECT sig.series, lo, (hi - lo) / {bins} AS w,
        CAST(least(floor((x - lo) / ((hi - lo) / {bins})), {bins} - 1) AS BIGINT) AS bin
      FROM sig JOIN span USING (series))"""


@query("histogram", f"""WITH {SIG}, {_HIST.format(bins=100)}
SELECT series, bin, {r('any_value(lo + bin * w)', 'left_edge')}, count(*) AS n FROM h GROUP BY series, bin""")
def histogram_100(spark, sf):
    sig = db_signal(spark, sf)
    return rounded(histogram(sig.df, ["series"], "x", 100, sig.n_series))


@query("density_histogram", f"""WITH {RAW}, {_HIST.format(bins=150000)},
n AS (SELECT series, bin, any_value(lo + bin * w) AS x, count(*) AS n FROM h GROUP BY series, bin),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY series) AS y FROM n QUALIFY y > 1e-6),
t AS (SELECT *, (lead(x) OVER o - x) * (lead(y) OVER o + y) / 2 AS area FROM s WINDOW o AS (PARTITION BY series ORDER BY bin))
SELECT series, bin, {r('x', 'x')}, {r('y / sum(area) OVER (PARTITION BY series)', 'y')} FROM t""")
def density_histogram(spark, sf):
    sig = raw_signal(spark, sf)
    return rounded(density(sig.df, ["series"], "x", n_groups=sig.n_series))


@query("normal_plot", f"""WITH {SIG},
k AS (SELECT series, x, row_number() OVER (PARTITION BY series ORDER BY x, seq) AS i, count(*) OVER (PARTITION BY series) AS n
      FROM sig WHERE seq % 100 = 0),
q AS (SELECT series, i, x, CASE WHEN i = n THEN pow(0.5e0, 1e0 / n) WHEN i = 1 THEN 1e0 - pow(0.5e0, 1e0 / n)
                                ELSE (i - 0.3175e0) / (n + 0.365e0) END AS p FROM k)
SELECT series, i AS rank, {r(normal_quantile("p"), 'theoretical')}, {r('x', 'observed')} FROM q""")
def normal_plot(spark, sf):
    """Every 100th sample against normal quantiles."""
    return rounded(qq_points(db_signal(spark, sf), "x"))


NULL_KEYS = """idx AS (
  SELECT CASE WHEN event_id % 3 > 0 THEN event_type END AS series, ts, event_id, 10 * log10(value) AS db
  FROM events WHERE value > 0),
sig AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts, event_id) - 1 AS seq,
               db - avg(db) OVER (PARTITION BY series) AS x FROM idx)"""


def _null_keys(spark, sf, **index):
    df = events(spark, sf).withColumn("series", F.when(F.col("event_id") % 3 > 0, F.col("series")))
    return rounded(load_signal(df, "value", ["ts", "event_id"], ["series"], CFG, **index).df.select("series", "seq", "x"))


@query("null_key_series", f"WITH {NULL_KEYS} SELECT series, seq, {r('x', 'x')} FROM sig")
def null_key_series(spark, sf):
    """A series without a name keeps all of its rows."""
    return _null_keys(spark, sf)


@query("null_key_series_ranges", f"WITH {NULL_KEYS} SELECT series, seq, {r('x', 'x')} FROM sig")
def null_key_series_ranges(spark, sf):
    """The same, numbered by range partitions."""
    return _null_keys(spark, sf, short_series=0, range_rows=500)


EMPTY_GROUPS = f"""
SELECT event_type AS series, name, {r('quantile_cont(v, 0.25)', 'q1')}, {r('quantile_cont(v, 0.75)', 'q3')}
FROM (SELECT event_type, 'v' AS name, CASE WHEN event_type <> 'click' THEN value END AS v FROM events) GROUP BY ALL"""


def _empty_groups(spark, sf, **how):
    df = events(spark, sf).withColumn("v", F.when(F.col("series") != "click", F.col("value")))
    q = quantiles(df, ["series"], ["v"], (0.25, 0.75), **how)
    return rounded(q.select("series", "name", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")))


@query("quantiles_empty_group", EMPTY_GROUPS)
def quantiles_empty_group(spark, sf):
    """A group without values has a row with null percentiles."""
    return _empty_groups(spark, sf)


@query("quantiles_empty_group_ranked", EMPTY_GROUPS)
def quantiles_empty_group_ranked(spark, sf):
    """The same, by ranks of a range sort."""
    return _empty_groups(spark, sf, short_group=0)


@query("quality_counts", """
SELECT event_type AS series, count(*) AS n_rows,
       count(*) FILTER (db IS NULL) AS n_nan, count(*) FILTER (isinf(db)) AS n_inf,
       round(min(db), 6) + 0.0 AS min_value, round(max(db), 6) + 0.0 AS max_value
FROM (SELECT event_type, CASE WHEN value > 0 THEN 10 * log10(value) END AS db FROM events) GROUP BY event_type""")
def quality(spark, sf):
    """Missing and infinite values after the decibel conversion."""
    from linkcast.functions.scalar import power_to_db

    df = events(spark, sf).withColumn("x", power_to_db("value", "null"))
    return rounded(quality_counts(df, ["series"], ["x"]))


@query("pearson_guarded", f"""WITH {SIG}, d AS (SELECT *, lag(x) OVER ({W}) AS p, 1.0::DOUBLE AS c FROM sig)
SELECT series, {r('corr(x, p)', 'corr_lag1')}, {r('0.0::DOUBLE', 'corr_constant')} FROM d GROUP BY series""")
def pearson_guarded(spark, sf):
    """Correlation with a zero-variance guard."""
    from linkcast.operators.windows import Lags

    df = add_features(db_signal(spark, sf), [Lags((1,), False, "x")], keep=["x"]).withColumn("c", F.lit(1.0))
    return rounded(df.groupBy("series").agg(
        pearson("x", "x_lag1").alias("corr_lag1"),
        F.coalesce(pearson("x", "c"), F.lit(0.0)).alias("corr_constant"),
    ))


@query("quantiles_many", """
WITH l AS (SELECT l_returnflag, 'l_quantity' AS name, l_quantity AS v FROM lineitem
           UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem)
SELECT l_returnflag, name, round(quantile_cont(v, 0.25), 4) + 0.0 AS p25,
       round(quantile_cont(v, 0.5), 4) + 0.0 AS p50, round(quantile_cont(v, 0.75), 4) + 0.0 AS p75
FROM l GROUP BY ALL""")
def quantiles_many(spark, sf):
    """Exact quartiles of two columns by ranks, groups of any size."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    qs = quantiles(df, ["l_returnflag"], ["l_quantity", "l_extendedprice"], (0.25, 0.5, 0.75), short_group=0)
    return rounded(qs.select(
        "l_returnflag", "name", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
    ), 4)
