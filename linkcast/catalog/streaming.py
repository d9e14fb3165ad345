"""The event table as a stream: rows out of order, rows too late, stops and restarts.

The events arrive in ``PARTS`` parts, in the order of their time plus a delay of up to six
hours, which the watermark of twelve hours covers. In the queries on late rows some events come a
whole part later. A run drains the stream after every part, and the next one goes on from the
checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcast.catalog.common import query, r, rounded
from linkcast.operators.ordering import index_series
from linkcast.operators.windows import Diff, Ema, Lags, Rolling, Targets, add_features
from linkcast.plans import forecast as fc
from linkcast.plans.dataset import Dataset
from linkcast.session import stage, stage_root
from linkcast.sources.sinks import save_model
from linkcast.streaming import online, parity, runs, scoring, windowed

PARTS, DELAY = 3, "12 hours"
SPEC = online.Spec()


def arrivals(spark: SparkSession, sf: str, late: bool = False) -> list[DataFrame]:
    """The events in parts as they arrive."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_type").alias("series"), "event_id", "ts", (10 * F.log10("value")).alias("x"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    ).where("x IS NOT NULL")
    lo, hi = rows.agg(F.min("us"), F.max("us")).first()
    if lo is None:
        lo = hi = 0
    after = f"us - {lo}L + ((event_id * 7919) % 21600) * 1000000L"
    part = F.least(F.lit(PARTS - 1).cast("long"), F.expr(f"(({after}) * {PARTS}) div {hi - lo + 1}L"))
    if late:
        part = F.when(F.expr("event_id % 97 = 0"), F.least(F.lit(PARTS - 1).cast("long"), part + 1)).otherwise(part)
    rows = stage(rows.withColumn("part", part.cast("int")), "arrivals")
    return [rows.where(F.col("part") == k).drop("part", "us") for k in range(PARTS)]


def _folders(spark: SparkSession) -> tuple[str, str, str]:
    """Input, output and checkpoint of a stream of its own."""
    root = f"{stage_root(spark)}/linkcast-stream-{uuid.uuid4().hex}"
    return f"{root}/in", f"{root}/out", f"{root}/checkpoint"


def _windows(spark: SparkSession, sf: str, size: str, slide: str | None, late: bool) -> tuple[DataFrame, str, DataFrame]:
    """What the stream gives out, its checkpoint, and all events."""
    source, out, checkpoint = _folders(spark)
    parts = arrivals(spark, sf, late)

    def run():
        stream = runs.file_stream(spark, source, parts[0].schema)
        found = windowed.windowed_statistics(stream, ["series"], "ts", "x", size, slide, DELAY)
        return runs.drain(runs.to_parquet(found, out), checkpoint)

    runs.feed(parts, source, run)
    return spark.read.parquet(out), checkpoint, spark.read.schema(parts[0].schema).parquet(source)


_HOUR = 3_600_000_000
# Parts, the watermark that stands when a part comes, and the last one.
ARRIVALS = f"""ev AS (
  SELECT event_type AS series, event_id, ts, epoch_us(ts) AS us, 10 * log10(value) AS x FROM events WHERE value > 0),
b AS (SELECT min(us) AS lo, max(us) AS hi FROM ev),
p AS (
  SELECT ev.*, least({PARTS - 1}, (us - lo + ((event_id * 7919) % 21600) * 1000000) * {PARTS} // (hi - lo + 1)) AS due FROM ev, b),
a AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN least({PARTS - 1}, due + 1) ELSE due END AS part FROM p),
m AS (SELECT part, max(us) AS last FROM a GROUP BY part),
w AS (
  SELECT a.*, coalesce((SELECT max(last) FROM m WHERE m.part < a.part) // 1000 * 1000 - 12 * {_HOUR}, -9e18::BIGINT) AS mark,
         (SELECT max(last) FROM m) // 1000 * 1000 - 12 * {_HOUR} AS final FROM a)"""
_STATS = f"""count(x) AS n, {r('avg(x)', 'mean')}, {r('stddev_samp(x)', 'std')}, {r('min(x)', 'min')}, {r('max(x)', 'max')},
       count(*) AS entries"""
_ENTRIES = f"""{ARRIVALS},
e AS (
  SELECT w.*, us - us % (3 * {_HOUR}) - k * 3 * {_HOUR} AS start, us - us % (3 * {_HOUR}) - k * 3 * {_HOUR} + 6 * {_HOUR} AS stop
  FROM w, (VALUES (0), (1)) v(k))"""


@query("stream_tumbling", f"""WITH {ARRIVALS}, e AS (SELECT *, us - us % (6 * {_HOUR}) AS start FROM w)
SELECT series, make_timestamp(start) AS window_start, make_timestamp(start + 6 * {_HOUR}) AS window_end, {_STATS}
FROM e WHERE start + 6 * {_HOUR} <= final GROUP BY series, start""")
def stream_tumbling(spark, sf):
    """Six-hour statistics of events out of order, three runs from one checkpoint."""
    return rounded(_windows(spark, sf, "6 hours", None, False)[0])


@query("stream_sliding", f"""WITH {_ENTRIES}
SELECT series, make_timestamp(start) AS window_start, make_timestamp(stop) AS window_end, {_STATS}
FROM e WHERE stop > mark AND stop <= final GROUP BY series, start, stop""")
def stream_sliding(spark, sf):
    """Overlapping windows; events that come after their window was given out are left out of it."""
    return rounded(_windows(spark, sf, "6 hours", "3 hours", True)[0])


@query("stream_late_entries", f"""WITH {_ENTRIES}
SELECT count(*) AS fed, count(*) FILTER (stop > mark AND stop <= final) AS given_out,
       count(*) FILTER (stop > mark AND stop > final) AS held, count(*) FILTER (stop <= mark) AS late FROM e""")
def stream_late_entries(spark, sf):
    """Where all entries of the sliding windows went: given out, still held, or late."""
    found, checkpoint, events = _windows(spark, sf, "6 hours", "3 hours", True)
    fed = 2 * events.count()
    held = windowed.open_entries(spark, checkpoint)
    late = windowed.late_entries(fed, found, spark, checkpoint)
    return spark.createDataFrame([(fed, fed - held - late, held, late)], "fed long, given_out long, held long, late long")


def _online(spark: SparkSession, source: str, schema) -> DataFrame:
    return online.online_features(runs.file_stream(spark, source, schema), "series", "ts", "event_id", "x", DELAY, SPEC)


def _rocksdb(spark: SparkSession):
    return runs.settings(spark, {runs.PROVIDER: runs.ROCKSDB})


def _signal(spark: SparkSession, sf: str):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_type").alias("series"), "ts", F.col("event_id").alias("row"), (10 * F.log10("value")).alias("x")
    ).where("x IS NOT NULL")
    return index_series(rows, ["series"], ["ts", "row"], ["row", "ts", "x"])


def _in_time(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Batch rows that the last watermark has passed."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    last = spark.read.parquet(f"{sf}/events.parquet").where("value > 0").agg(F.max(us)).first()[0]
    return rows.where(us <= (last or 0) // 1000 * 1000 - 12 * _HOUR)


def batch_features(spark: SparkSession, sf: str) -> DataFrame:
    """The same features from the batch families."""
    families = [
        Diff("x"), Lags(SPEC.taps, True, "x"), Rolling(SPEC.windows, ("mean", "std", "min", "max"), 1, "x"),
        Ema(SPEC.alphas, False, "x"),
    ]
    found = add_features(_signal(spark, sf), families, keep=["row", "ts", "x"])
    return _in_time(spark, sf, found).select("series", "row", "seq", "x", *SPEC.names())


_W = "(PARTITION BY series ORDER BY seq)"
_LIVE = """sig AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY us, event_id) - 1 AS seq FROM w)"""
_TAPS = ", ".join(
    r(f"lag(x, {k}) OVER {_W} - lag(x, {k + 1}) OVER {_W}", f"x_diff_lag{k}") for k in SPEC.taps
)
_FRAMES = ", ".join(
    r(f"{fn}(x) OVER (PARTITION BY series ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)", f"x_rolling_{s}_{n}")
    for n in SPEC.windows for s, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
)
ONLINE_SQL = f"""WITH RECURSIVE {ARRIVALS}, {_LIVE},
e AS (
  SELECT series, seq, x AS e1, x AS e3 FROM sig WHERE seq = 0
  UNION ALL
  SELECT s.series, s.seq, 0.9 * e1 + 0.1 * s.x, 0.7 * e3 + 0.3 * s.x FROM e JOIN sig s ON s.series = e.series AND s.seq = e.seq + 1),
f AS (SELECT series, event_id AS row, seq, us, final, {r('x', 'x')}, {r(f'x - lag(x) OVER {_W}', 'x_diff')}, {_TAPS}, {_FRAMES} FROM sig)
SELECT f.* EXCLUDE (us, final), {r('e1', 'x_ema_0_1')}, {r('e3', 'x_ema_0_3')} FROM f JOIN e USING (series, seq) WHERE us <= final"""


@query("stream_online_features", ONLINE_SQL)
def stream_online_features(spark, sf):
    """Features of live links from keyed state, three runs from one checkpoint."""
    source, out, checkpoint = _folders(spark)
    parts = arrivals(spark, sf)

    def run():
        with _rocksdb(spark):
            return runs.drain(runs.to_parquet(_online(spark, source, parts[0].schema), out), checkpoint)

    runs.feed(parts, source, run)
    return rounded(spark.read.parquet(out))


def saved_model(spark: SparkSession, sf: str) -> str:
    """Folder of a least-squares model of the change five samples ahead, by the last difference."""
    rows = add_features(_signal(spark, sf), [Diff("x"), Targets((5,), True, "x")], keep=["x"])
    rows = rows.withColumnRenamed("target_5", "y").na.drop().withColumn("split", F.lit("train"))
    fitted = fc.fit("linear", Dataset(rows, None, ["x_diff"], 5, ("series",)))
    path = f"{stage_root(spark)}/linkcast-model-{uuid.uuid4().hex}"
    save_model(fitted.model, path)
    return path


def _scored(spark: SparkSession, sf: str, model: str) -> tuple[DataFrame, int]:
    """Scores of the live stream, whose driver is lost once between writing and committing a batch."""
    source, out, checkpoint = _folders(spark)
    parts = arrivals(spark, sf)
    write = scoring.batch_folder(out, scoring.scorer(model, ["x_diff"], "x", ["series", "row", "seq"]))
    with _rocksdb(spark):
        restarts = parity.replay(
            parts, source, checkpoint, write,
            lambda w: scoring.to_batches(_online(spark, source, parts[0].schema), w), crash_at=2,
        )
    return scoring.read_batches(spark, out), restarts


_MODEL = f"""{_LIVE},
g AS (SELECT *, x - lag(x) OVER {_W} AS d, lead(x, 5) OVER {_W} - x AS y FROM sig),
c AS (SELECT regr_slope(y, d) AS slope, regr_intercept(y, d) AS base FROM g WHERE d IS NOT NULL AND y IS NOT NULL)"""


@query("stream_scoring", f"""WITH {ARRIVALS}, {_MODEL}
SELECT series, event_id AS row, seq, {r('x', 'level_now')}, {r('base + slope * d', 'prediction')}, {r('x + base + slope * d', 'predicted_level')}
FROM g, c WHERE us <= final AND d IS NOT NULL""")
def stream_scoring(spark, sf):
    """A saved model on live features; the batch that was written twice is there once."""
    return rounded(_scored(spark, sf, saved_model(spark, sf))[0])


@query("parity_windows", f"""WITH {ARRIVALS}, g AS (
  SELECT series, us - us % (6 * {_HOUR}) AS start FROM w WHERE us - us % (6 * {_HOUR}) + 6 * {_HOUR} <= final GROUP BY ALL)
SELECT count(*) AS n_stream, count(*) AS n_batch, 0::BIGINT AS n_differing, 1::BIGINT AS restarts FROM g""")
def parity_windows(spark, sf):
    """Windows of an interrupted stream against the batch."""
    source, out, checkpoint = _folders(spark)
    parts = arrivals(spark, sf)
    stats = lambda df, delay: windowed.windowed_statistics(df, ["series"], "ts", "x", "6 hours", None, delay)
    restarts = parity.replay(
        parts, source, checkpoint, scoring.batch_folder(out),
        lambda w: scoring.to_batches(stats(runs.file_stream(spark, source, parts[0].schema), DELAY), w), crash_at=2,
    )
    whole = stats(spark.read.schema(parts[0].schema).parquet(source), None).withColumn("ts", F.col("window_end"))
    batch = _in_time(spark, sf, whole).drop("ts")
    return parity.summary(scoring.read_batches(spark, out), batch, ["series", "window_start"], restarts)


@query("parity_online", f"""WITH {ARRIVALS}
SELECT count(*) AS n_stream, count(*) AS n_batch, 0::BIGINT AS n_differing, 1::BIGINT AS restarts FROM w WHERE us <= final""")
def parity_online(spark, sf):
    """Online features of an interrupted stream against the batch families."""
    source, out, checkpoint = _folders(spark)
    parts = arrivals(spark, sf)
    with _rocksdb(spark):
        restarts = parity.replay(
            parts, source, checkpoint, scoring.batch_folder(out),
            lambda w: scoring.to_batches(_online(spark, source, parts[0].schema), w), crash_at=2,
        )
    return parity.summary(scoring.read_batches(spark, out), batch_features(spark, sf), ["series", "row"], restarts)


@query("parity_scoring", f"""WITH {ARRIVALS}, {_LIVE}
SELECT count(*) AS n_stream, count(*) AS n_batch, 0::BIGINT AS n_differing, 1::BIGINT AS restarts FROM sig WHERE us <= final AND seq > 0""")
def parity_scoring(spark, sf):
    """Scores of an interrupted stream against scoring the batch."""
    model = saved_model(spark, sf)
    stream, restarts = _scored(spark, sf, model)
    batch = scoring.scorer(model, ["x_diff"], "x", ["series", "row", "seq"])(batch_features(spark, sf))
    return parity.summary(stream, batch, ["series", "row"], restarts)
