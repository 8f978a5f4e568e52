"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each query end to end on ``local[$BENCH_CPUS]`` and forces full
execution with the ``noop`` sink (every row computed, nothing collected).
``curate_dataset`` always recomputes curation from the source tables (and
publishes the training set under its configuration name if no copy exists);
the later queries read that dataset, as the reference's jobs read its
exported file.
Prints one JSON line: total seconds and per-query seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "curate_dataset",          # flagship: curation end to end
    "curation_funnel",         # every stage counted
    "scroll_variance",         # skew-safe windowed metric
    "label_codes",             # distributed dense codes
    "quantile_normalize",      # exact quantile fit + normal transform
    "training_table",          # split + transform + codes
    "regression_metrics",
    "error_by_bin",
    "histogram_25",
    "speed_comparison",        # serving grid, latest year, pivot
    "unplayed_pairs",
    "holdout_predictions",     # ALS fit + scoring
    "stream_scoring",          # structured streaming, stream-static join
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from scorelens.plans.registry import queries
    from scorelens.session import cleanup_scratch, get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "8g"})
    qs = queries()
    # Warm-up on the smallest tables (JIT, class loading); not counted.
    qs["curate_dataset"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()

    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))
    cleanup_scratch(spark)  # this run's intermediate tables; the published dataset stays
    spark.stop()


if __name__ == "__main__":
    main()
