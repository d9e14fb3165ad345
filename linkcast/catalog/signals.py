"""Scans, scalar functions, filters and alignment joins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from linkcast.catalog.common import (
    CFG, IDX, PRICE, SIG, W, baseline_results, db_signal, events, price_signal, query, r,
    RESULTS, rounded, uncentred_signal,
)
from linkcast.config import Config
from linkcast.functions.scalar import (
    dbm_to_watts, improvement_pct, increase_pct, power_to_db, power_to_irradiance, samples_to_ms,
)
from linkcast.operators.ordering import index_series
from linkcast.operators.windows import Diff, Lags, add_features
from linkcast.plans.reports import near_best
from linkcast.sources.signals import limit, metadata


@query("signal_scan", f"""WITH {SIG} SELECT series, seq, {r('x', 'x')} FROM sig WHERE seq < 1000000""")
def signal_scan(spark, sf):
    cfg = replace(CFG, signal=replace(CFG.signal, max_samples=Config().signal.max_samples))
    return rounded(db_signal(spark, sf, cfg).df)


@query("series_index", f"WITH {PRICE} SELECT series, seq, l_orderkey, l_linenumber, x FROM sig")
def series_index(spark, sf):
    return price_signal(spark, sf).df


@query("series_index_ranges", f"WITH {PRICE} SELECT series, seq, l_orderkey, l_linenumber, x FROM sig")
def series_index_ranges(spark, sf):
    """The same numbering by range partitions, as used for series of any length."""
    return price_signal(spark, sf, short_series=0, range_rows=20_000).df


@query("long_series_index", """
SELECT 'all' AS series, event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events""")
def long_series_index(spark, sf):
    """One series that holds every row."""
    df = events(spark, sf).withColumn("series", F.lit("all"))
    sig = index_series(df, ["series"], ["ts", "event_id"], ["event_id"], short_series=0, range_rows=4_000)
    return sig.df.select("series", "event_id", "seq")


@query("signal_metadata", f"""WITH {IDX}
SELECT series, count(*) AS n_samples, 10000 AS sampling_rate, {r('count(*) / 1e4', 'duration_sec')},
       {r('avg(db)', 'mean_db')}, {r('stddev_pop(db)', 'std_db')},
       {r('min(db) - avg(db)', 'min_db')}, {r('max(db) - avg(db)', 'max_db')}
FROM idx GROUP BY series""")
def signal_metadata(spark, sf):
    return rounded(metadata(uncentred_signal(spark, sf), CFG))


@query("power_to_db", f"""SELECT event_id, {r('CASE WHEN value > 0 THEN 10 * log10(value) END', 'db')} FROM events""")
def to_db(spark, sf):
    return rounded(events(spark, sf).select("event_id", power_to_db("value", "null").alias("db")))


@query("dbm_to_watts", f"""
SELECT event_id, {r('pow(10.0::DOUBLE, (10 * log10(value) - 30) / 10)', 'watts')} FROM events WHERE value > 0""")
def to_watts(spark, sf):
    df = events(spark, sf).where("value > 0")
    return rounded(df.select("event_id", dbm_to_watts(power_to_db("value")).alias("watts")))


@query("mean_centring", f"WITH {SIG} SELECT series, seq, {r('x', 'x')} FROM sig")
def mean_centring(spark, sf):
    return rounded(db_signal(spark, sf).df)


@query("power_to_irradiance", f"""
SELECT event_id, {r('value / 1e6 / (pi() * pow(0.007::DOUBLE / 2, 2))', 'irradiance')} FROM events""")
def irradiance(spark, sf):
    watts = F.col("value") / F.lit(1e6)
    return rounded(events(spark, sf).select("event_id", power_to_irradiance(watts, 7e-3).alias("irradiance")))


@query("samples_to_ms", f"WITH {SIG} SELECT series, seq, {r('seq / 1e4 * 1000', 'ms')} FROM sig")
def to_ms(spark, sf):
    return rounded(db_signal(spark, sf).df.select("series", "seq", samples_to_ms("seq").alias("ms")))


@query("first_difference", f"WITH {SIG} SELECT series, seq, {r(f'x - lag(x) OVER ({W})', 'x_diff')} FROM sig")
def first_difference(spark, sf):
    return rounded(add_features(db_signal(spark, sf), [Diff("x")]))


@query("drop_incomplete", f"""WITH {SIG}, d AS (
  SELECT series, seq, x - lag(x) OVER ({W}) AS x_diff, lag(x, 20) OVER ({W}) AS x_lag20 FROM sig)
SELECT series, seq, {r('x_diff', 'x_diff')}, {r('x_lag20', 'x_lag20')} FROM d
WHERE x_diff IS NOT NULL AND x_lag20 IS NOT NULL""")
def drop_incomplete(spark, sf):
    fam = [Diff("x"), Lags((20,), False, "x")]
    return rounded(add_features(db_signal(spark, sf), fam).na.drop(subset=["x_diff", "x_lag20"]))


@query("fill_gaps", f"""WITH {SIG}
SELECT series, seq, {r(f'coalesce(x - lag(x, 50) OVER ({W}), -9999)', 'residual')} FROM sig""")
def fill_gaps(spark, sf):
    df = add_features(db_signal(spark, sf), [Lags((50,), False, "x")], keep=["x"])
    gaps = df.select("series", "seq", (F.col("x") - F.col("x_lag50")).alias("residual"))
    return rounded(gaps.na.fill(-9999.0, subset=["residual"]))


@query("competitive_results", f"""WITH {RESULTS}
SELECT model_name, horizon, {r('test_rmse', 'test_rmse')}, {r('training_time', 'training_time')} FROM res
WHERE horizon IN (5, 100) AND training_time > 0 AND test_rmse <= 1.1 * (SELECT min(test_rmse) FROM res)""")
def competitive_results(spark, sf):
    """Membership and threshold filters over a results table."""
    kept = near_best(baseline_results(spark, sf), "test_rmse", 1.1)
    kept = kept.where(F.col("horizon").isin(5, 100) & (F.col("training_time") > 0))
    return rounded(kept.select("model_name", "horizon", "test_rmse", "training_time"))


@query("percentages", f"""WITH {RESULTS}
SELECT model_name, horizon, {r('(0.2234 - test_rmse) / 0.2234 * 100', 'improvement')},
       {r('(test_rmse - train_rmse) / train_rmse * 100', 'overfitting')} FROM res""")
def percentages(spark, sf):
    return rounded(baseline_results(spark, sf).select(
        "model_name", "horizon",
        improvement_pct(F.lit(0.2234), "test_rmse").alias("improvement"),
        increase_pct("train_rmse", "test_rmse").alias("overfitting"),
    ))


@query("attach_statistics", f"""WITH {IDX}
SELECT series, seq, {r('db', 'x')}, {r('avg(db) OVER (PARTITION BY series)', 'mean')},
       {r('stddev_pop(db) OVER (PARTITION BY series)', 'std')} FROM idx""")
def attach_statistics(spark, sf):
    """One row of statistics per series joined to all its rows."""
    sig = uncentred_signal(spark, sf)
    stats = sig.df.groupBy("series").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return rounded(sig.attach(stats))


@query("carry_last_row", f"""WITH {SIG}, b AS (
  SELECT series, seq // 512 AS block, max_by(x, seq) AS last_x, count(*) AS n FROM sig GROUP BY ALL)
SELECT cur.series, cur.block, cur.n, {r('prev.last_x', 'carried')}
FROM b cur LEFT JOIN b prev ON prev.series = cur.series AND prev.block = cur.block - 1""")
def carry_last_row(spark, sf):
    """The last row of each block handed to the next block by an equi-join."""
    df = db_signal(spark, sf).df.withColumn("block", F.floor(F.col("seq") / 512))
    ends = df.groupBy("series", "block").agg(F.max_by("x", "seq").alias("last_x"), F.count("*").alias("n"))
    prev = ends.select("series", (F.col("block") + 1).alias("block"), F.col("last_x").alias("carried"))
    return rounded(ends.join(prev, ["series", "block"], "left").select("series", "block", "n", "carried"))


@query("first_rows", f"WITH {SIG} SELECT series, seq, {r('x', 'x')} FROM sig WHERE seq < 10000")
def first_rows(spark, sf):
    """The first rows in order (a training window of fixed size)."""
    sig = db_signal(spark, sf)
    return rounded(limit(sig, 10_000).df)


@query("every_kth_row", f"WITH {SIG} SELECT series, seq, {r('x', 'x')} FROM sig WHERE seq % 100 = 0")
def every_kth_row(spark, sf):
    """The sampling step of the normal plot."""
    return rounded(db_signal(spark, sf).df.where(F.col("seq") % 100 == 0))
