"""Summarise the executed physical plans of the registered queries.

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md

For each query the final adaptive plan (after running it into the ``noop``
sink) is scanned for the operators that matter at scale: Parquet scans and
their pushed filters, shuffles, broadcasts, join strategies, partial window
limits, reads of checkpointed data and Python stages.  Work done by eager
checkpoints while the plan is built runs as its own jobs and shows up here
only as ``Scan ExistingRDD``.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.plans import registry  # noqa: E402
from quarry.session import build_session  # noqa: E402

PATTERNS = {
    "parquet scans": r"FileScan parquet",
    "scans with pushed filters": r"PushedFilters: \[[^\]]",
    "checkpoint reads": r"Scan ExistingRDD",
    "hash shuffles": r"Exchange hashpartitioning",
    "range shuffles": r"Exchange rangepartitioning",
    "round-robin shuffles": r"Exchange RoundRobinPartitioning",
    "broadcasts": r"BroadcastExchange",
    "broadcast joins": r"BroadcastHashJoin|BroadcastNestedLoopJoin",
    "sort-merge joins": r"SortMergeJoin",
    "partial window limits": r"WindowGroupLimit .*Partial",
    "python stages": r"MapInPandas|PythonMapInArrow|ArrowEvalPython|BatchEvalPython",
}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(shuffle_partitions=8)
    qs = registry.queries()
    names = names or list(qs)
    cols = list(PATTERNS)
    print(f"# Executed plans ({os.path.basename(sf_dir.rstrip('/'))})\n")
    print("Counts of operators in the final adaptive plan of each registered query "
          "(`python scripts/plan_report.py`). Eager checkpoints run as separate jobs "
          "before this plan; their output is read back as `Scan ExistingRDD`.\n")
    print("| query | " + " | ".join(cols) + " |")
    print("| --- |" + " --- |" * len(cols))
    for name in names:
        df = qs[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = [len(re.findall(PATTERNS[c], plan)) for c in cols]
        print(f"| `{name}` | " + " | ".join(str(n) for n in counts) + " |", flush=True)


if __name__ == "__main__":
    main()
