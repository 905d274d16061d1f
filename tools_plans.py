"""Summarise the physical plans of the headline queries (for PLANS.md).

Usage: python tools_plans.py [sf_dir]
"""

import re
import sys

from bench import HEADLINE
from cohortkit.plans.driver_tables import SPARK
from cohortkit.session import get_spark


def summary(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    exch = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
    return {
        "exchanges": exch,
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "python_stages": plan.count("MapInPandas") + plan.count("FlatMapGroupsInPandas")
        + plan.count("FlatMapCoGroupsInPandas"),
        "windows": plan.count("Window ["),
        "pushed": sorted(set(re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan))),
        "read": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", 16, extra={"spark.ui.enabled": "false"})
    for name in HEADLINE:
        s = summary(SPARK[name](spark, sf))
        print(f"### {name}\n")
        print(f"exchanges {s['exchanges']}, broadcast joins {s['broadcast_joins']}, sort-merge joins "
              f"{s['sort_merge_joins']}, Python stages {s['python_stages']}, windows {s['windows']}\n")
        for p in s["pushed"]:
            if p:
                print(f"- pushed: `{p}`")
        for r in s["read"]:
            print(f"- read: `{r}`")
        print()


if __name__ == "__main__":
    main()
