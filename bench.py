"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run once to warm up, then timed (median of $BENCH_REPS runs; the
result is fully computed with a ``noop`` write so nothing is collected).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import platform
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortkit.plans.driver_tables import SPARK  # noqa: E402
from cohortkit.session import get_spark  # noqa: E402

HEADLINE = [
    "history_panel_stats",
    "history_panel_wide",
    "group_summary",
    "label_windows",
    "training_table",
    "index_class_onehot",
    "demographics_onehot",
    "impute_median",
    "split_exact",
    "stratified_folds",
    "roc_auc_by_lang",
    "classification_report",
    "kaplan_meier",
    "concordance_index",
    "cox_hazard_ratios",
]


def run_once(spark, name, sf_dir):
    t = time.time()
    SPARK[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - t


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_PARTITIONS", cpus * 2)),
                      extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "16g"),
                             "spark.ui.enabled": "false"})
    out = {}
    for n in names:
        run_once(spark, n, sf_dir)  # warm-up
        ts = [run_once(spark, n, sf_dir) for _ in range(reps)]
        out[n] = round(statistics.median(ts), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "median_query_seconds_sum",
        "value": round(sum(out.values()), 3),
        "unit": "sec",
        "queries": out,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "reps": reps,
        "memory": os.environ.get("BENCH_MEM", "16g"),
        "machine": platform.machine(),
    }))


if __name__ == "__main__":
    main()
