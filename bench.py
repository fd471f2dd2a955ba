"""Benchmark: wall time of the headline queries.

Runs each query in HEADLINE on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and executes it fully into Spark's no-op sink (no
collect to the driver).  Prints one JSON line.  ``--all`` times every
registered query instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans import registry  # noqa: E402
from quarry.session import build_session  # noqa: E402

HEADLINE = [
    "profile_table", "profile_by_group", "histogram", "top_values", "duplicate_rows",
    "custom_metrics", "compare_commits", "rule_summary", "commit_chain", "verify_chain",
    "ancestry", "project_log", "log_with_metrics", "metric_filter_or", "storage_by_author",
    "state_at", "dedup_savings", "tree_hash", "list_metadata", "global_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    qs = registry.queries()
    names = list(qs) if "--all" in sys.argv else HEADLINE
    times: dict[str, float] = {}
    # Warm the JVM (class loading, JIT) once on the smallest tables, so the
    # first timed query is not charged for it.
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in ("profile_table", "project_log"):
            qs[name](spark, warm).write.format("noop").mode("overwrite").save()
    qs["load_dataset"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    sf_name = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf: float | str = float(sf_name)
    except ValueError:
        sf = sf_name
    print(json.dumps({"metric": "headline_total_wall", "value": total, "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
