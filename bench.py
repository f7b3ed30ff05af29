"""Benchmark: headline workloads at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is forced to completion with the no-op sink (nothing is pulled
to the driver); ``value`` is the sum of per-query wall seconds.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabprobe.plans import workloads  # noqa: E402
from tabprobe.session import get_session  # noqa: E402

HEADLINE = [
    "split_holdout", "split_stratified", "fit_sample_topk", "ordinal_encode", "median_impute",
    "target_encode_bin", "target_encode_oof", "prep_for_generation", "family_input_linear",
    "pearson_cols", "spearman_cols", "eta_cols", "cap_columns", "feature_efficiency",
    "auc_binary", "auc_ovr_macro", "knn_topk", "knn_predict", "overview_pivot", "by_task_sector",
    "corpus_dedupe", "key_duplicates", "leaderboard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * int(cpus)))
    # warm the JVM (class loading, code generation) on the smallest tables so
    # start-up is not charged to the first measured query
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in ("split_stratified", "spearman_cols", "eta_cols", "knn_topk", "overview"):
            workloads.SPARK[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only:
        t0 = time.time()
        df = workloads.SPARK[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]:.2f}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_workloads_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
