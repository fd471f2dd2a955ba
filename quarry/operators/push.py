"""The upload path as one Spark job over a batch of uploads.

``push`` takes uploaded files that are already hashed (``cas.hash_files``)
and the current catalog, and derives what the reference's upload endpoint
writes, for a whole batch at once:

1. quota - authors whose stored bytes are already above the quota are
   rejected (strictly greater, the incoming file not counted);
2. dedup - a blob is new when neither the registry nor an earlier upload of
   the batch holds its hash;
3. trees - one entry per upload; tree hash of the one-entry manifest;
4. commits - every accepted upload becomes a commit chained onto the newest
   existing commit of its (project, branch), in (created_at, seq) order;
5. audit - one COMMIT_ACCEPTED row per commit.

Profiling the accepted files and appending their documents is
``documents.profile_document`` + ``sinks.index_append``; the streaming form is
``streaming.incremental``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import cas
from quarry.operators.lineage import QUOTA_BYTES, storage_by_author

UPLOAD_COLUMNS = ["seq", "blob_hash", "size_bytes", "file_name", "project_id", "branch",
                  "author_id", "message", "created_at"]


def push(uploads: DataFrame, commits: DataFrame, entries: DataFrame, blobs: DataFrame,
         quota_bytes: int = QUOTA_BYTES) -> dict[str, DataFrame]:
    """Accept a batch of uploads against the catalog.

    ``uploads``: UPLOAD_COLUMNS.  ``commits`` must carry ``commit_hash`` next
    to (id, project_id, author_id, branch, created_at, tree_id).  Returns
    ``rejected`` (uploads over quota), ``commits`` (seq, parent_hash,
    commit_hash, tree_hash, is_duplicate, ...), ``new_blobs``,
    ``tree_entries`` and ``audit``.
    """
    usage = storage_by_author(blobs, entries, commits)
    over = usage.where(F.col("used_bytes") > quota_bytes).select("author_id")
    rejected = uploads.join(over, "author_id", "left_semi")
    accepted = uploads.join(over, "author_id", "left_anti")

    registry = blobs.select("blob_hash").withColumn("__stored", F.lit(True))
    firsts = accepted.groupBy("blob_hash").agg(F.min("seq").alias("__first"))
    flagged = (accepted.join(firsts, "blob_hash").join(registry, "blob_hash", "left")
               .withColumn("is_duplicate", F.coalesce(F.col("__stored"), F.lit(False))
                           | (F.col("seq") > F.col("__first")))
               .drop("__stored", "__first"))
    new_blobs = (flagged.where(~F.col("is_duplicate"))
                 .select("blob_hash", "size_bytes", F.col("seq").alias("first_seq")))

    tree_entries = flagged.select(F.col("seq").alias("tree_id"), F.col("file_name").alias("name"),
                                  F.lit("file").alias("mode"), F.col("blob_hash").alias("object_hash"))
    trees = cas.tree_hash(tree_entries)

    heads = (commits.groupBy("project_id", "branch")
                    .agg(F.max_by("commit_hash", F.struct("created_at", "id")).alias("head_hash")))
    chained_in = (flagged.join(heads, ["project_id", "branch"], "left")
                         .withColumn("id", F.col("seq")))
    chain = cas.commit_chain(chained_in, start_col="head_hash")
    new_commits = (flagged.join(chain.withColumnRenamed("id", "seq"), "seq")
                          .join(trees.withColumnRenamed("tree_id", "seq"), "seq")
                          .select("seq", "project_id", "branch", "author_id", "message",
                                  "created_at", "file_name", "blob_hash", "is_duplicate",
                                  "parent_hash", "commit_hash", "tree_hash"))
    details = F.to_json(F.struct(F.col("file_name").alias("file"),
                                 F.col("project_id").alias("project"),
                                 F.col("is_duplicate"), F.lit("background").alias("indexing")))
    audit = new_commits.select(F.col("author_id").alias("user_id"),
                               F.lit("COMMIT_ACCEPTED").alias("action"),
                               F.lit("commits").alias("table_name"),
                               F.col("commit_hash").alias("record_id"),
                               details.alias("details"), F.col("created_at").alias("performed_at"))
    return {"rejected": rejected, "commits": new_commits, "new_blobs": new_blobs,
            "tree_entries": tree_entries, "audit": audit}
