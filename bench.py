"""Time the headline queries: one JSON line with seconds per query.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS
(timed runs per query, median taken), BENCH_QUERIES (comma-separated names).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabkit import catalog
from tabkit.session import build_session

HEADLINE = [
    "profile_by_target", "value_counts_pct", "two_key_counts", "likert_diverging", "multi_key_join", "combine_first",
    "date_offset_lag", "date_parts_cyclic", "skew_label", "transform_skew", "corr_long", "exact_quantiles",
    "box_stats", "qq_fit", "impute_median_mode", "ffill", "interp_linear", "interp_cubic", "decompose",
    "decompose_readings", "resample_month", "ts_folds", "strat_split", "scale_minmax", "column_bundle", "roc_curve",
    "roc_auc", "rmse_r2", "impurity_importance",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session("tabkit-bench", cores)
    seconds = {}
    for name in names:
        query, taken = catalog.QUERIES[name], []
        for _ in range(runs + 1):
            start = time.perf_counter()
            # the noop sink computes every row and column without bringing them to the driver
            query(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
