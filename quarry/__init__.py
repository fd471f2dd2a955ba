"""quarry - dataset profiling, content-addressed lineage and catalog queries on Spark.

The main entry points, re-exported for convenience::

    from quarry import profile_table, load_dataset, project_log, commit_chain
"""

from quarry.functions.metricql import metric_predicate
from quarry.operators.cas import (commit_chain, content_hash, dedup_blobs, hash_files,
                                  tree_hash, verify_chain)
from quarry.operators.lineage import (ancestry, ancestry_by_pointers, branch_heads,
                                      compare_profiles, global_stats, orphan_blobs,
                                      project_log, state_at, storage_by_author)
from quarry.operators.profile import (custom_metrics, duplicate_rows, histogram, mode,
                                      profile_by_group, profile_table, profile_tables,
                                      top_values)
from quarry.operators.push import push
from quarry.operators.documents import profile_document
from quarry.operators.summary import profile_context, rule_summary
from quarry.session import build_session
from quarry.sources.readers import load_dataset, preview_rows

__version__ = "0.1.0"

__all__ = [
    "metric_predicate", "commit_chain", "content_hash", "dedup_blobs", "hash_files",
    "tree_hash", "verify_chain", "ancestry", "ancestry_by_pointers", "branch_heads",
    "compare_profiles", "global_stats", "orphan_blobs", "project_log", "state_at",
    "storage_by_author", "custom_metrics", "duplicate_rows", "histogram", "mode",
    "profile_by_group", "profile_table", "profile_tables", "top_values", "push",
    "profile_context", "profile_document", "rule_summary", "build_session", "load_dataset",
    "preview_rows",
]
