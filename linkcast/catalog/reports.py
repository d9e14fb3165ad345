"""Comparison tables, rankings and recommendations over a results table."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkcast.catalog.common import BASELINES, RESULTS, baseline_results, query, r, rounded
from linkcast.plans import reports
from linkcast.session import stage_root
from linkcast.sources import sinks

MODELS = [name for name, _, _ in BASELINES]
_DIGITS = 6


def _r(*cols):
    return ", ".join(r(c, c, _DIGITS) for c in cols)


@query("results_table", f"""WITH {RESULTS}
SELECT model_name, horizon, model_complexity, {_r('train_rmse', 'val_rmse', 'test_rmse', 'test_mae', 'test_r2',
  'residual_variance', 'pred_variance', 'training_time', 'inference_time_per_sample_ms')},
  n_train_samples, n_test_samples FROM res""")
def results_table(spark, sf):
    return rounded(baseline_results(spark, sf))


@query("append_results", f"""WITH {RESULTS}
SELECT model_name, horizon, {_r('test_rmse')}, CAST(NULL AS INT) AS lookback FROM res WHERE horizon <> 50
UNION ALL SELECT model_name, horizon, {_r('test_rmse')}, CAST(least(2 * horizon, 200) AS INT) FROM res WHERE horizon = 50""")
def append_results(spark, sf):
    """Two results tables, one with an additional column."""
    from linkcast.operators.sequences import default_lookback

    res = baseline_results(spark, sf).select("model_name", "horizon", "test_rmse")
    extra = res.where("horizon = 50").withColumn("lookback", F.lit(default_lookback(50)))
    return rounded(reports.append_results([res.where("horizon <> 50"), extra]))


_CMP = """SELECT model_name, horizon, {cols},
       round((0.2234 - test_rmse) / 0.2234 * 100, 6) + 0.0 AS vs_baseline_pct,
       round((test_rmse - train_rmse) / train_rmse * 100, 6) + 0.0 AS overfitting_pct FROM res"""
_CMP_COLS = _r("test_rmse", "test_mae", "pred_variance", "training_time", "inference_time_per_sample_ms")


@query("compare_models", f"WITH {RESULTS} {_CMP.format(cols=_CMP_COLS)} ORDER BY horizon, test_rmse, model_name")
def compare_models(spark, sf):
    return rounded(reports.compare_models(baseline_results(spark, sf)))


@query("compare_with_model", f"""WITH {RESULTS}
SELECT a.model_name, a.horizon, {r('a.test_rmse', 'test_rmse')},
       {r('(b.test_rmse - a.test_rmse) / b.test_rmse * 100', 'vs_baseline_pct')}
FROM res a JOIN res b ON b.model_name = 'Naive' AND b.horizon = a.horizon""")
def compare_with_model(spark, sf):
    """The baseline is a model of the same table, per horizon."""
    out = reports.compare_models(baseline_results(spark, sf), baseline="Naive")
    return rounded(out.select("model_name", "horizon", "test_rmse", "vs_baseline_pct"))


_BEST = f"""model_name, horizon, {_r('test_rmse', 'test_mae', 'test_r2', 'training_time', 'inference_time_per_sample_ms')},
  {r('horizon / 1e4 * 1000', 'horizon_ms')}, {r('(0.2234 - test_rmse) / 0.2234 * 100', 'vs_baseline_pct')}"""
_BEST_COLS = [
    "model_name", "horizon", "test_rmse", "test_mae", "test_r2", "training_time",
    "inference_time_per_sample_ms", "horizon_ms", "vs_baseline_pct",
]


@query("best_overall", f"WITH {RESULTS} SELECT {_BEST} FROM res ORDER BY res.test_rmse, res.model_name, res.horizon LIMIT 1")
def best_overall(spark, sf):
    return rounded(reports.best_overall(baseline_results(spark, sf)).select(_BEST_COLS))


@query("best_per_horizon", f"""WITH {RESULTS} SELECT {_BEST} FROM res
QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY res.test_rmse, res.model_name) = 1""")
def best_per_horizon(spark, sf):
    return rounded(reports.best_per_horizon(baseline_results(spark, sf)).select(_BEST_COLS))


@query("rank_models", f"""WITH {RESULTS}, a AS (
  SELECT model_name, avg(test_rmse) AS ar, avg(test_mae) AS am, avg(test_r2) AS a2, avg(training_time) AS tt,
         avg(inference_time_per_sample_ms) AS ai FROM res GROUP BY model_name)
SELECT model_name, {r('ar', 'avg_rmse')}, {r('am', 'avg_mae')}, {r('a2', 'avg_r2')}, {r('tt', 'avg_training_time')},
       {r('ai', 'avg_inference_time_ms')}, CAST(row_number() OVER (ORDER BY ar, model_name) AS INT) AS rank,
       {r('(0.2234 - ar) / 0.2234 * 100', 'vs_baseline_pct')} FROM a""")
def rank_models(spark, sf):
    return rounded(reports.rank_models(baseline_results(spark, sf)))


@query("horizon_trend", f"""WITH {RESULTS}, t AS (
  SELECT model_name, min_by(test_rmse, horizon) AS f, max_by(test_rmse, horizon) AS l FROM res GROUP BY model_name)
SELECT model_name, {r('f', 'first_rmse')}, {r('l', 'last_rmse')}, {r('(l - f) / f * 100', 'rmse_change_pct')} FROM t""")
def horizon_trend(spark, sf):
    return rounded(reports.horizon_trend(baseline_results(spark, sf)))


@query("recommendations", f"""WITH {RESULTS}
SELECT 'accuracy' AS criterion, model_name AS model, horizon, {r('test_rmse', 'value')}
FROM (SELECT * FROM res ORDER BY test_rmse, model_name, horizon LIMIT 1)
UNION ALL SELECT 'speed_accuracy', model_name, horizon, {r('training_time', 'value')}
FROM (SELECT * FROM res WHERE test_rmse <= 1.1 * (SELECT min(test_rmse) FROM res)
        AND (SELECT max(training_time) FROM res) > 0 ORDER BY training_time, model_name, horizon LIMIT 1)
UNION ALL SELECT 'inference', model_name, horizon, {r('inference_time_per_sample_ms', 'value')}
FROM (SELECT * FROM res ORDER BY inference_time_per_sample_ms, model_name, horizon LIMIT 1)
UNION ALL SELECT 'stability', model_name, NULL, {r('s', 'value')}
FROM (SELECT model_name, stddev_samp(test_rmse) AS s FROM res GROUP BY model_name ORDER BY s, model_name LIMIT 1)""")
def recommendations(spark, sf):
    return rounded(reports.recommendations(baseline_results(spark, sf)))


@query("overall_statistics", f"""WITH {RESULTS}
SELECT count(DISTINCT model_name) AS n_models, list(DISTINCT horizon ORDER BY horizon) AS horizons,
       count(*) AS n_evaluations FROM res""")
def overall_statistics(spark, sf):
    return reports.overall(baseline_results(spark, sf))


@query("rmse_by_horizon", f"""WITH {RESULTS}
SELECT horizon, {', '.join(r(f"max(test_rmse) FILTER (model_name = '{m}')", '"' + m + '"') for m in MODELS)}
FROM res GROUP BY horizon""")
def rmse_by_horizon(spark, sf):
    """One column per model."""
    return rounded(reports.metric_by_horizon(baseline_results(spark, sf), MODELS))


_MS = r("horizon / 1e4 * 1000", "horizon_ms")


@query("chart_errors", f"WITH {RESULTS} SELECT model_name, horizon, {_MS}, {_r('test_rmse', 'test_r2', 'residual_variance')} FROM res")
def chart_errors(spark, sf):
    return rounded(reports.chart_tables(baseline_results(spark, sf))["errors"])


@query("chart_time_vs_error", f"""WITH {RESULTS}
SELECT model_name, horizon, {_MS}, {_r('training_time', 'test_rmse')} FROM res WHERE res.training_time > 0""")
def chart_time_vs_error(spark, sf):
    return rounded(reports.chart_tables(baseline_results(spark, sf))["time_vs_error"])


@query("chart_inference", f"""WITH {RESULTS}
SELECT model_name, {r('avg(inference_time_per_sample_ms)', 'avg_inference_time_ms')} FROM res GROUP BY model_name""")
def chart_inference(spark, sf):
    return rounded(reports.chart_tables(baseline_results(spark, sf))["inference"])


@query("chart_complexity", f"""WITH {RESULTS}
SELECT model_name, {r('avg(model_complexity)', 'avg_complexity')} FROM res GROUP BY model_name""")
def chart_complexity(spark, sf):
    return rounded(reports.chart_tables(baseline_results(spark, sf))["complexity"])


@query("top_results", f"""WITH {RESULTS}
SELECT model_name, horizon, {r('test_mae', 'test_mae')} FROM res ORDER BY res.test_mae DESC, model_name LIMIT 10""")
def top_results(spark, sf):
    """Descending order and the first ten rows."""
    res = baseline_results(spark, sf).select("model_name", "horizon", "test_mae")
    return rounded(res.orderBy(F.desc("test_mae"), "model_name").limit(10))


_SAVED = f"WITH {RESULTS} SELECT model_name, horizon, {_r('test_rmse', 'test_mae')} FROM res"


def _path(spark, name):
    import uuid

    return f"{stage_root(spark)}/linkcast-{name}-{uuid.uuid4().hex}"


@query("results_csv", _SAVED)
def results_csv(spark, sf):
    """Written as CSV with a header and read back."""
    res = baseline_results(spark, sf).select("model_name", "horizon", "test_rmse", "test_mae")
    path = _path(spark, "results")
    sinks.write_results(res, path, "csv")
    return rounded(spark.read.schema(res.schema).option("header", True).csv(path))


@query("results_parquet", _SAVED)
def results_parquet(spark, sf):
    res = baseline_results(spark, sf).select("model_name", "horizon", "test_rmse", "test_mae")
    path = _path(spark, "results")
    sinks.write_results(res, path)
    return rounded(spark.read.schema(res.schema).parquet(path))


@query("metrics_json", f"""WITH {RESULTS}
SELECT model_name, CAST(horizon AS VARCHAR) AS horizon, {r('test_rmse', 'test_rmse')}, {r('train_rmse', 'train_rmse')} FROM res""")
def metrics_json(spark, sf):
    """Nested metrics per model and horizon written as JSON and flattened again."""
    path = _path(spark, "metrics")
    docs = baseline_results(spark, sf)
    sinks.write_metrics(docs, path)
    entry = "struct<test_metrics:struct<test_rmse:double>,train_metrics:struct<train_rmse:double>>"
    back = spark.read.schema(f"model_name string, horizons map<string,{entry}>").json(path)
    flat = back.select("model_name", F.explode("horizons").alias("horizon", "m"))
    return rounded(flat.select(
        "model_name", "horizon", F.col("m.test_metrics.test_rmse").alias("test_rmse"),
        F.col("m.train_metrics.train_rmse").alias("train_rmse"),
    ))
