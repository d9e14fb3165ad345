"""What leaves the library and comes back: condition tables, saved models, exported residuals, own features."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import functions as F

from linkcast.catalog.common import CFG, QUERIES, SIG, SQL, W, db_signal, events, query, r, rounded
from linkcast.catalog.onetap import one_tap_sets
from linkcast.plans import forecast as fc
from linkcast.plans.features import engineer_features, register_feature
from linkcast.session import stage_root
from linkcast.sources import sinks
from linkcast.sources.signals import read_conditions

CONDITIONS = ("click", "purchase", "signup")


def _folder(spark, name):
    return f"{stage_root(spark)}/linkcast-{name}-{uuid.uuid4().hex}"


@query("condition_union", f"""SELECT event_type AS series, count(*) AS n, {r('sum(value)', 'total')}, min(event_id) AS first_id
FROM events WHERE event_type IN ('click', 'signup') GROUP BY event_type""")
def condition_union(spark, sf):
    """Two of three conditions' tables, each written to a folder of its own and read through the catalogue."""
    root = _folder(spark, "conditions")
    for name in CONDITIONS:
        events(spark, sf).where(F.col("series") == name).drop("series").write.parquet(f"{root}/{name}")
    found = read_conditions(spark, {name: f"{root}/{name}" for name in CONDITIONS}, ["click", "signup"])
    return rounded(found.groupBy("series").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("event_id").alias("first_id")
    ))


@query("model_round_trip", SQL["one_tap_scoring"])
def model_round_trip(spark, sf):
    """A fitted pipeline, saved and loaded, predicts the test rows."""
    ds = one_tap_sets(spark, sf)[5]
    path = _folder(spark, "model")
    sinks.save_model(fc.fit("linear", ds).model, path)
    scored = fc.scored_levels(sinks.load_model(path).transform(ds.part("test")))
    return rounded(scored.select("series", "seq", "level", "predicted_level", "residual"))


@query("residual_export", SQL["residual_matrix"])
def residual_export(spark, sf):
    """The residual matrix as CSV with a header, read back."""
    matrix = QUERIES["residual_matrix"](spark, sf)
    path = _folder(spark, "residuals")
    sinks.write_results(matrix, path, "csv")
    return spark.read.schema(matrix.schema).option("header", True).csv(path)


@dataclass(frozen=True)
class Spread:
    """Distance of the largest from the smallest of the last ``window`` samples."""

    window: int = 10
    base: str = "x"

    def reach(self):
        return self.window - 1, 0

    def names(self):
        return [f"{self.base}_spread_{self.window}"]

    def levels(self, f):
        x, back = F.col(self.base), -(self.window - 1)
        return [{self.names()[0]: f.over(F.max(x), back, 0) - f.over(F.min(x), back, 0)}]


@query("custom_feature", f"""WITH {SIG}, f AS (
  SELECT series, seq, x, max(x) OVER s - min(x) OVER s AS spread, avg(x) OVER (PARTITION BY series ORDER BY seq ROWS 4 PRECEDING) AS m
  FROM sig WINDOW s AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT series, seq, {r('spread', 'x_spread_10')}, {r('m', 'x_rolling_mean_5')} FROM f WHERE seq >= 5""")
def custom_feature(spark, sf):
    """A registered feature family next to a built-in one."""
    register_feature("spread", lambda cfg: Spread(base=cfg.base))
    cfg = CFG.with_features(
        enable_lags=False, rolling_windows=(5,), rolling_stats=("mean",), enable_ema=False, enable_acf=False,
        enable_spectral=False, enable_trend=False, custom=("spread",),
    )
    found = engineer_features(db_signal(spark, sf), 5, cfg)
    return rounded(found.select("series", "seq", "x_spread_10", "x_rolling_mean_5"))
