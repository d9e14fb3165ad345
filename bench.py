"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from linkcast.catalog import QUERIES
from linkcast.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# Preparation first: these are the stages whose cost the baseline states.
HEADLINE = (
    "signal_scan",
    "series_index_ranges",
    "lagged_differences",
    "rolling_statistics",
    "exponential_average",
    "rolling_autocorrelation",
    "rolling_spectrum",
    "trend_residual",
    "feature_set",
    "feature_set_all",
    "feature_set_prices",
    "multi_horizon_features",
    "ratio_split",
    "scaled_features",
    "prepared_dataset",
    "sequence_windows",
    "autocorrelation",
    "density_histogram",
    "regression_metrics",
    "recommendations",
    "latency_sweep",
    "linear_regression",
)


def main():
    spark = local_session(CPUS, "bench")
    rows = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    items = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    # The baseline states 30 to 60 s per million samples for this step (an
    # estimate on unknown hardware), i.e. 17,000 to 33,000 rows per second.
    full, prices = times["feature_set_all"], times["feature_set_prices"]
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")), "event_rows": rows,
        "item_rows": items, "feature_rows_per_sec": round(rows / full),
        "feature_rows_per_sec_items": round(items / prices), "cpus": CPUS,
    }))


if __name__ == "__main__":
    main()
