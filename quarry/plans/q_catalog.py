"""Catalog-family queries (content addressing, lineage, listings) and oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.metricql import metric_predicate_sql
from quarry.functions.text import iso_sql
from quarry.operators import cas
from quarry.operators import lineage as L
from quarry.plans.catalog import CATALOG_SQL, Catalog, with_catalog
from quarry.plans.stored import stored_metadata
from quarry.session import scratch_dir
from quarry.sources.sinks import text_files
from quarry.sources.tables import table

METRIC_ONE = "accuracy > 0.5"
METRIC_AND = "k > 50, k < 80"
METRIC_OR = "k > 90 OR accuracy > 0.9, loss < 0.03"
LOG_METRIC = "accuracy > 0.5, loss < 0.05"
LOG_PROJECT = "NATION_1"
LOG_BRANCH = "1-URGENT"
LOG_SINCE, LOG_UNTIL = "1996-01-01", "1996-12-31T23:59:59"
STATE_AS_OF = "1997-01-01T00:00:00"

FIRST_ENTRY_SQL = ("SELECT tree_id, arg_min(object_hash, id) AS blob_hash FROM tree_entries "
                   "GROUP BY tree_id")
COMMITS_BLOB_SQL = (f"SELECT c.*, coalesce(f.blob_hash, '') AS blob_hash FROM commits c "
                    f"LEFT JOIN ({FIRST_ENTRY_SQL}) f ON c.tree_id = f.tree_id")
PARENT_SQL = ("SELECT id, lag(id) OVER (PARTITION BY project_id, branch ORDER BY created_at, id) "
              "AS parent_id FROM commits")
CHAIN_SQL = f"""
c AS (SELECT id, project_id, branch, message, blob_hash,
             row_number() OVER (PARTITION BY project_id, branch ORDER BY created_at, id) AS rn
      FROM ({COMMITS_BLOB_SQL})),
chain AS (
  SELECT project_id, branch, rn, id, CAST(NULL AS VARCHAR) AS parent_hash,
         sha256(message || blob_hash) AS commit_hash FROM c WHERE rn = 1
  UNION ALL
  SELECT c.project_id, c.branch, c.rn, c.id, chain.commit_hash,
         sha256(chain.commit_hash || c.message || c.blob_hash)
  FROM c JOIN chain ON c.project_id = chain.project_id AND c.branch = chain.branch
                   AND c.rn = chain.rn + 1)"""


def _cat(spark, sf):
    return Catalog(spark, sf)


def _docs(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("blob_hash"),
                    F.octet_length("text").cast("long").alias("size_bytes"))


def _chain(cat):
    cb = L.commits_with_blob(cat.commits, cat.tree_entries)
    return cb, cas.commit_chain(cb)


# ---------------------------------------------------------------------------
# content addressing
# ---------------------------------------------------------------------------

def q_content_hash(spark, sf):
    return cas.content_hash(table(spark, sf, "documents").select("doc_id", "text"), "text") \
              .select("doc_id", "content_hash")


def q_table_fingerprint(spark, sf):
    docs = table(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("text"))
    return cas.table_fingerprint(cas.content_hash(docs, "text"), "content_hash")


def q_first_occurrence(spark, sf):
    return (cas.first_occurrence(_docs(spark, sf), "blob_hash", "seq")
               .select(F.col("seq").alias("doc_id"), "blob_hash",
                       F.col("first_seq").alias("first_doc_id"), "is_duplicate"))


def q_dedup_blobs(spark, sf):
    cat = _cat(spark, sf)
    # the registry holds the parts and some of the documents already
    registry = cat.blobs.where((F.col("origin") == "part") | F.col("blob_hash").rlike("^[0-4]"))
    return (cas.dedup_blobs(_docs(spark, sf), registry)
               .select("blob_hash", F.col("first_seq").alias("first_doc_id"), "size_bytes", "copies"))


def q_dedup_savings(spark, sf):
    return cas.dedup_savings(_docs(spark, sf), "blob_hash", "size_bytes")


def q_is_duplicate_blob(spark, sf):
    cat = _cat(spark, sf)
    # every seventh upload has new content
    new = F.sha2(F.concat(F.col("object_hash"), F.lit("+")), 256)
    batch = cat.tree_entries.select("id", F.when(F.col("id") % 7 == 0, new).otherwise(F.col("object_hash")).alias("blob_hash"))
    return cas.is_duplicate_blob(batch, cat.blobs).select("id", "blob_hash", "is_duplicate")


def q_tree_hash(spark, sf):
    return cas.tree_hash(_cat(spark, sf).tree_entries)


def q_first_tree_entry(spark, sf):
    return cas.first_tree_entry(_cat(spark, sf).tree_entries)


def q_commit_chain(spark, sf):
    _, chain = _chain(_cat(spark, sf))
    return chain


def q_verify_chain(spark, sf):
    cb, chain = _chain(_cat(spark, sf))
    # some messages and parent pointers have been tampered with
    stored = (cb.join(chain, "id")
                .withColumn("message", F.when(F.col("id") % 11 == 0, F.concat("message", F.lit("!"))).otherwise(F.col("message")))
                .withColumn("parent_hash", F.when(F.col("id") % 13 == 0, F.lit("forged")).otherwise(F.col("parent_hash"))))
    return cas.verify_chain(stored)


def q_hash_files(spark, sf):
    # one text file per supplier
    folder = text_files(table(spark, sf, "supplier"), scratch_dir(spark, f"files-{uuid.uuid4().hex}"), "s_suppkey", "s_name")
    return (cas.hash_files(spark, folder)
               .select(F.regexp_extract("path", r"s_suppkey=([^/]+?)(/|\.txt$)", 1).cast("long").alias("file_key"),
                       "blob_hash", F.col("size_bytes").cast("long").alias("size_bytes")))


# ---------------------------------------------------------------------------
# lineage and catalog queries
# ---------------------------------------------------------------------------

def q_parent_commit(spark, sf):
    return L.parent_commits(_cat(spark, sf).commits)


def q_commit_parent(spark, sf):
    return L.commit_parent(_cat(spark, sf).commits)


def q_branch_heads(spark, sf):
    return L.branch_heads(_cat(spark, sf).commits)


def q_ancestry(spark, sf):
    cat = _cat(spark, sf)
    heads = L.branch_heads(cat.commits).select(F.col("head_id").alias("id"))
    return L.ancestry(cat.commits, heads)


def q_state_at(spark, sf):
    cat = _cat(spark, sf)
    return L.state_at(cat.commits, cat.tree_entries, STATE_AS_OF)


def _log(spark, sf, **kw):
    cat = _cat(spark, sf)
    return L.project_log(cat.commits, cat.users, stored_metadata(spark, sf), cat.projects, **kw)


def q_project_log(spark, sf):
    return _log(spark, sf)


def q_project_log_records(spark, sf):
    # one project, hashes of its commits, records nested in their commit
    cat = _cat(spark, sf)
    log = L.project_log(cat.commits, cat.users, stored_metadata(spark, sf), cat.projects, project=LOG_PROJECT, nested=True, chain=_chain(cat)[1])
    return log.select("project", "commit_id", "commit_hash", "parent_hash", "message", "branch", "author", "created_at",
                      F.size("metadata").cast("long").alias("records"),
                      F.array_join(F.transform("metadata", lambda r: r["file_name"]), ",").alias("file_names"),
                      F.aggregate("metadata", F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["row_count"], F.lit(0))).alias("rows"),
                      F.get_json_object(F.get("metadata", F.lit(0))["custom_metrics"], "$.loss").try_cast("double").alias("loss"))


def q_log_branch_filter(spark, sf):
    return _log(spark, sf, branch=LOG_BRANCH)


def q_log_time_range(spark, sf):
    return _log(spark, sf, since=LOG_SINCE, until=LOG_UNTIL)


def q_log_with_metrics(spark, sf):
    return _log(spark, sf, metric=LOG_METRIC)


def q_commits_matching_metric(spark, sf):
    return _log(spark, sf, metric=LOG_METRIC, drop_empty=True)


def _metric_rows(spark, sf, expr):
    return L.with_metric(stored_metadata(spark, sf), expr).select("id", "file_name")


def q_metric_filter(spark, sf):
    return _metric_rows(spark, sf, METRIC_ONE)


def q_metric_filter_and(spark, sf):
    return _metric_rows(spark, sf, METRIC_AND)


def q_metric_filter_or(spark, sf):
    return _metric_rows(spark, sf, METRIC_OR)


def q_list_metadata(spark, sf):
    cat = _cat(spark, sf)
    return L.listing(stored_metadata(spark, sf), cat.commits, cat.projects, limit=50)


def q_filter_file_type(spark, sf):
    return stored_metadata(spark, sf).where("file_type = 'csv'").select("id", "file_name")


def q_projection_list(spark, sf):
    return stored_metadata(spark, sf).select("id", "file_name", "file_type", "row_count", "column_count")


def q_metadata_with_project(spark, sf):
    cat = _cat(spark, sf)
    return L.metadata_with_project(cat.metadata, cat.commits, cat.projects) \
            .select("id", "target_id", "project_name")


def q_metadata_in_project(spark, sf):
    cat = _cat(spark, sf)
    c = cat.commits.select(F.col("id").alias("target_id"), "project_id")
    p = cat.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return cat.metadata.join(c, "target_id").join(p, "project_id").select("id", "project_name")


def q_version_detail(spark, sf):
    cat = _cat(spark, sf)
    m = L.version_details(cat.metadata, cat.commits, cat.projects, cat.tree_entries)
    return (m.select(
        "id", "project_name", "blob_hash", F.substring("blob_hash", 1, 8).alias("short_hash"),
        L.json_field("stats", "file_name").alias("file_name"),
        L.json_field("stats", "row_count").try_cast("long").alias("row_count"),
        L.json_field("stats", "custom_metrics.accuracy.latest").try_cast("double").alias("accuracy")))


def q_resolve_blob(spark, sf):
    cat = _cat(spark, sf)
    return L.resolve_blob(cat.metadata, cat.commits, cat.tree_entries)


def q_newest_metadata(spark, sf):
    # every third commit has been indexed again, a day later, under another name
    md = _cat(spark, sf).metadata.where("target_id > 0").select("id", "target_id", L.json_field("stats", "file_name").alias("file_name"), "indexed_at")
    again = md.where("target_id % 3 = 0").select(
        (F.col("id") + 2000000000000).alias("id"), "target_id", F.concat(F.lit("again_"), "file_name").alias("file_name"),
        (F.col("indexed_at") + F.expr("INTERVAL 1 DAY")).alias("indexed_at"))
    return L.newest_records(md.unionByName(again), "target_id").select("id", "target_id", "file_name")


def q_version_by_id(spark, sf):
    md = _cat(spark, sf).metadata
    key = md.where(F.col("target_id") > 0).agg(F.max("id")).first()[0]
    return L.lookup(md, "id", key).select("id", "target_id", L.json_field("stats", "file_name").alias("file_name"))


def q_commit_by_key(spark, sf):
    c = _cat(spark, sf).commits
    key = c.agg(F.max("id")).first()[0]
    return L.lookup(c, "id", key).select("id", "project_id", "author_id", "branch", "message")


def q_commit_metadata_view(spark, sf):
    cat = _cat(spark, sf)
    p = cat.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    m = cat.metadata.select(F.col("target_id").alias("id"),
                            L.json_field("stats", "row_count").alias("row_count"),
                            L.json_field("stats", "file_name").alias("file_name"))
    return (cat.commits.join(p, "project_id").join(m, "id", "left")
               .select(F.col("id").alias("commit_id"), "message", "branch",
                       F.col("created_at").alias("committed_at"), "project", "row_count", "file_name"))


def q_commit_author(spark, sf):
    cat = _cat(spark, sf)
    u = cat.users.select(F.col("id").alias("author_id"), F.col("username").alias("author"))
    return cat.commits.join(u, "author_id", "left").select("id", "author")


def q_project_owner(spark, sf):
    cat = _cat(spark, sf)
    u = cat.users.select(F.col("id").alias("owner_id"), F.col("username").alias("owner"))
    return cat.projects.join(u, "owner_id", "left").select("id", "name", "owner")


def q_list_projects(spark, sf):
    cat = _cat(spark, sf)
    u = cat.users.select(F.col("id").alias("owner_id"), F.col("username").alias("owner"))
    # A project is created with its first commit; shown as an ISO date.
    first = (cat.commits.groupBy(F.col("project_id").alias("id"))
             .agg(F.min("created_at").alias("first_commit")))
    return (cat.projects.join(u, "owner_id", "left").join(first, "id", "left")
            .select("id", "name", "description", "owner",
                    F.to_date("first_commit").cast("string").alias("created_at")))


def q_new_projects(spark, sf):
    cat = _cat(spark, sf)
    incoming = (table(spark, sf, "region").select(F.col("r_name").alias("name"))
                .unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("name"))))
    return incoming.distinct().join(cat.projects.select("name"), "name", "left_anti")


def q_distinct_refs(spark, sf):
    return _cat(spark, sf).tree_entries.select("object_hash").distinct()


def q_supported_extension(spark, sf):
    e = _cat(spark, sf).tree_entries
    ext = F.regexp_extract(F.lower("name"), r"(\.[^./]+)$", 1)
    return (e.select("id", "name", ext.alias("ext"))
             .where(F.col("ext").isin(".csv", ".json", ".parquet")))


def q_orphan_blobs(spark, sf):
    cat = _cat(spark, sf)
    return L.orphan_blobs(cat.blobs, cat.tree_entries).select("blob_hash", "size_bytes")


def q_orphans(spark, sf):
    cat = _cat(spark, sf)
    return (L.orphan_blobs(cat.blobs, cat.tree_entries)
            .select("blob_hash", "size_bytes", "origin",
                    F.round(F.col("size_bytes") / 1024.0, 1).alias("size_kb")))


def q_gc_summary(spark, sf):
    cat = _cat(spark, sf)
    return L.gc_summary(L.orphan_blobs(cat.blobs, cat.tree_entries))


def q_storage_by_author(spark, sf):
    cat = _cat(spark, sf)
    return L.storage_by_author(cat.blobs, cat.tree_entries, cat.commits)


def q_storage_by_author_dedup(spark, sf):
    cat = _cat(spark, sf)
    return L.storage_by_author(cat.blobs, cat.tree_entries, cat.commits, dedup=True)


def q_over_quota(spark, sf):
    cat = _cat(spark, sf)
    return L.over_quota(L.storage_by_author(cat.blobs, cat.tree_entries, cat.commits))


def q_global_stats(spark, sf):
    cat = _cat(spark, sf)
    return L.global_stats(cat.commits, cat.blobs, cat.metadata, cat.projects)


def q_audit_with_user(spark, sf):
    cat = _cat(spark, sf)
    return L.audit_with_user(cat.audit_log, cat.users).select("id", "user", "action", "record_id")


def q_audit_tail(spark, sf):
    cat = _cat(spark, sf)
    return L.audit_tail(cat.audit_log, cat.users)


def q_open_pulls(spark, sf):
    pr = _cat(spark, sf).pull_requests
    return pr.where(F.col("status") == "open").select("id", "project_id", "title", "source_branch",
                                                       "target_branch")


QUERIES = {
    "content_hash": q_content_hash,
    "table_fingerprint": q_table_fingerprint,
    "first_occurrence": q_first_occurrence,
    "dedup_blobs": q_dedup_blobs,
    "dedup_savings": q_dedup_savings,
    "is_duplicate_blob": q_is_duplicate_blob,
    "tree_hash": q_tree_hash,
    "first_tree_entry": q_first_tree_entry,
    "commit_chain": q_commit_chain,
    "verify_chain": q_verify_chain,
    "hash_files": q_hash_files,
    "parent_commit": q_parent_commit,
    "commit_parent": q_commit_parent,
    "branch_heads": q_branch_heads,
    "ancestry": q_ancestry,
    "state_at": q_state_at,
    "project_log": q_project_log,
    "project_log_records": q_project_log_records,
    "log_branch_filter": q_log_branch_filter,
    "log_time_range": q_log_time_range,
    "log_with_metrics": q_log_with_metrics,
    "commits_matching_metric": q_commits_matching_metric,
    "metric_filter": q_metric_filter,
    "metric_filter_and": q_metric_filter_and,
    "metric_filter_or": q_metric_filter_or,
    "list_metadata": q_list_metadata,
    "filter_file_type": q_filter_file_type,
    "projection_list": q_projection_list,
    "metadata_with_project": q_metadata_with_project,
    "metadata_in_project": q_metadata_in_project,
    "version_detail": q_version_detail,
    "resolve_blob": q_resolve_blob,
    "newest_metadata": q_newest_metadata,
    "version_by_id": q_version_by_id,
    "commit_by_key": q_commit_by_key,
    "commit_metadata_view": q_commit_metadata_view,
    "commit_author": q_commit_author,
    "project_owner": q_project_owner,
    "list_projects": q_list_projects,
    "new_projects": q_new_projects,
    "distinct_refs": q_distinct_refs,
    "supported_extension": q_supported_extension,
    "orphan_blobs": q_orphan_blobs,
    "orphans": q_orphans,
    "gc_summary": q_gc_summary,
    "storage_by_author": q_storage_by_author,
    "storage_by_author_dedup": q_storage_by_author_dedup,
    "over_quota": q_over_quota,
    "global_stats": q_global_stats,
    "audit_with_user": q_audit_with_user,
    "audit_tail": q_audit_tail,
    "open_pulls": q_open_pulls,
}


# ---------------------------------------------------------------------------
# oracles
# ---------------------------------------------------------------------------

DOCS_SQL = ("SELECT doc_id AS seq, sha256(text) AS blob_hash, CAST(strlen(text) AS BIGINT) AS size_bytes "
            "FROM documents")


def _log_sql(branch=None, since=None, until=None, metric=None, drop_empty=False):
    where = []
    if branch is not None:
        where.append(f"c.branch = '{branch}'")
    if since is not None:
        where.append(f"c.created_at >= TIMESTAMP '{since.replace('T', ' ')}'")
    if until is not None:
        where.append(f"c.created_at <= TIMESTAMP '{until.replace('T', ' ')}'")
    w = ("WHERE " + " AND ".join(where)) if where else ""
    mp = metric_predicate_sql(metric, "json_extract(stats, '$.custom_metrics')")
    join = "JOIN" if drop_empty else "LEFT JOIN"
    return with_catalog(f"""
SELECT p.name AS project, c.id AS commit_id, c.message, c.branch, u.username AS author,
       {iso_sql('c.created_at')} AS created_at, m.metadata_id, m.file_name, m.row_count, m.column_count
FROM commits c JOIN projects p ON c.project_id = p.id
LEFT JOIN users u ON c.author_id = u.id
{join} (SELECT target_id, id AS metadata_id, json_extract_string(stats, '$.file_name') AS file_name,
               TRY_CAST(json_extract_string(stats, '$.row_count') AS BIGINT) AS row_count,
               TRY_CAST(json_extract_string(stats, '$.column_count') AS BIGINT) AS column_count
        FROM metadata WHERE {mp}) m ON m.target_id = c.id
{w}""", "commits", "projects", "users", "metadata")


def _metric_sql(expr):
    mp = metric_predicate_sql(expr, "json_extract(stats, '$.custom_metrics')")
    return with_catalog(f"SELECT id, json_extract_string(stats, '$.file_name') AS file_name "
                        f"FROM metadata WHERE {mp}", "metadata")


_MWP = """SELECT m.*, coalesce(p.name, 'unknown') AS project_name
FROM metadata m LEFT JOIN commits c ON m.target_id = c.id LEFT JOIN projects p ON c.project_id = p.id"""

_STORAGE_JOIN = """FROM commits c JOIN tree_entries e ON c.tree_id = e.tree_id
JOIN blobs b ON b.blob_hash = e.object_hash"""

_ORPHANS = "SELECT * FROM blobs WHERE blob_hash NOT IN (SELECT DISTINCT object_hash FROM tree_entries)"

ORACLE = {
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "table_fingerprint": """
SELECT count(*) AS n_rows, CAST(sum(CAST(CAST('0x' || substr(sha256(coalesce(text, '')), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS hash_sum FROM documents""",
    "first_occurrence": f"""
SELECT seq AS doc_id, blob_hash, min(seq) OVER (PARTITION BY blob_hash) AS first_doc_id,
       seq > min(seq) OVER (PARTITION BY blob_hash) AS is_duplicate FROM ({DOCS_SQL})""",
    "dedup_blobs": with_catalog(f"""
SELECT blob_hash, min(seq) AS first_doc_id, min(size_bytes) AS size_bytes, count(*) AS copies
FROM ({DOCS_SQL}) d WHERE blob_hash NOT IN (SELECT blob_hash FROM blobs WHERE origin = 'part' OR regexp_matches(blob_hash, '^[0-4]'))
GROUP BY blob_hash""", "blobs"),
    "dedup_savings": f"""
SELECT CAST(sum(n) AS BIGINT) AS uploads, count(*) AS distinct_blobs,
       CAST(sum(n * sz) AS BIGINT) AS logical_bytes, CAST(sum(sz) AS BIGINT) AS stored_bytes,
       CAST(sum(n * sz) - sum(sz) AS BIGINT) AS saved_bytes
FROM (SELECT blob_hash, count(*) AS n, min(size_bytes) AS sz FROM ({DOCS_SQL}) GROUP BY blob_hash)""",
    "is_duplicate_blob": with_catalog("""
SELECT e.id, e.blob_hash, EXISTS (SELECT 1 FROM blobs b WHERE b.blob_hash = e.blob_hash) AS is_duplicate
FROM (SELECT id, CASE WHEN id % 7 = 0 THEN sha256(object_hash || '+') ELSE object_hash END AS blob_hash
      FROM tree_entries) e""", "tree_entries", "blobs"),
    "tree_hash": with_catalog("""
SELECT tree_id, sha256('{' || string_agg('"' || name || '": "' || object_hash || '"', ', ' ORDER BY name)
       || '}') AS tree_hash, count(*) AS entries FROM tree_entries GROUP BY tree_id""", "tree_entries"),
    "first_tree_entry": with_catalog("""
SELECT tree_id, id AS entry_id, name, object_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY id) AS rn FROM tree_entries) WHERE rn = 1""",
        "tree_entries"),
    "parent_commit": with_catalog(PARENT_SQL, "commits"),
    "commit_parent": with_catalog(f"""
SELECT x.id, x.parent_id, p.message AS parent_message FROM ({PARENT_SQL}) x
LEFT JOIN commits p ON p.id = x.parent_id""", "commits"),
    "branch_heads": with_catalog("""
SELECT project_id, branch, arg_max(id, (created_at, id)) AS head_id, count(*) AS commits
FROM commits GROUP BY project_id, branch""", "commits"),
    "state_at": with_catalog(f"""
SELECT project_id, branch, name, arg_max(object_hash, (created_at, commit_id)) AS object_hash,
       arg_max(commit_id, (created_at, commit_id)) AS commit_id
FROM (SELECT c.project_id, c.branch, c.id AS commit_id, c.created_at, e.name, e.object_hash
      FROM commits c JOIN tree_entries e ON c.tree_id = e.tree_id
      WHERE c.created_at <= TIMESTAMP '{STATE_AS_OF.replace('T', ' ')}')
GROUP BY project_id, branch, name""", "commits", "tree_entries"),
    "project_log": _log_sql(),
    "log_branch_filter": _log_sql(branch=LOG_BRANCH),
    "log_time_range": _log_sql(since=LOG_SINCE, until=LOG_UNTIL),
    "log_with_metrics": _log_sql(metric=LOG_METRIC),
    "commits_matching_metric": _log_sql(metric=LOG_METRIC, drop_empty=True),
    "metric_filter": _metric_sql(METRIC_ONE),
    "metric_filter_and": _metric_sql(METRIC_AND),
    "metric_filter_or": _metric_sql(METRIC_OR),
    "list_metadata": with_catalog(f"""
SELECT id, target_id, project_name, json_extract_string(stats, '$.file_name') AS file_name,
       json_extract_string(stats, '$.file_type') AS file_type,
       TRY_CAST(json_extract_string(stats, '$.row_count') AS BIGINT) AS row_count,
       TRY_CAST(json_extract_string(stats, '$.column_count') AS BIGINT) AS column_count,
       {iso_sql('indexed_at')} AS indexed_at
FROM ({_MWP}) ORDER BY indexed_at DESC, id DESC LIMIT 50""", "metadata", "commits", "projects"),
    "filter_file_type": with_catalog("""
SELECT id, json_extract_string(stats, '$.file_name') AS file_name FROM metadata
WHERE json_extract_string(stats, '$.file_type') = 'csv'""", "metadata"),
    "projection_list": with_catalog("""
SELECT id, json_extract_string(stats, '$.file_name') AS file_name,
       json_extract_string(stats, '$.file_type') AS file_type,
       TRY_CAST(json_extract_string(stats, '$.row_count') AS BIGINT) AS row_count,
       TRY_CAST(json_extract_string(stats, '$.column_count') AS BIGINT) AS column_count FROM metadata""",
        "metadata"),
    "metadata_with_project": with_catalog(f"SELECT id, target_id, project_name FROM ({_MWP})",
                                          "metadata", "commits", "projects"),
    "metadata_in_project": with_catalog("""
SELECT m.id, p.name AS project_name FROM metadata m JOIN commits c ON m.target_id = c.id
JOIN projects p ON c.project_id = p.id""", "metadata", "commits", "projects"),
    "version_detail": with_catalog(f"""
SELECT m.id, m.project_name, coalesce(f.blob_hash, CAST(m.target_id AS VARCHAR)) AS blob_hash,
       substr(coalesce(f.blob_hash, CAST(m.target_id AS VARCHAR)), 1, 8) AS short_hash,
       json_extract_string(m.stats, '$.file_name') AS file_name,
       TRY_CAST(json_extract_string(m.stats, '$.row_count') AS BIGINT) AS row_count,
       TRY_CAST(json_extract_string(m.stats, '$.custom_metrics.accuracy.latest') AS DOUBLE) AS accuracy
FROM ({_MWP}) m LEFT JOIN commits c ON m.target_id = c.id
LEFT JOIN ({FIRST_ENTRY_SQL}) f ON f.tree_id = c.tree_id""", "metadata", "commits", "projects",
        "tree_entries"),
    "resolve_blob": with_catalog(f"""
SELECT m.id, m.target_id, coalesce(f.blob_hash, CAST(m.target_id AS VARCHAR)) AS blob_hash
FROM metadata m LEFT JOIN commits c ON m.target_id = c.id
LEFT JOIN ({FIRST_ENTRY_SQL}) f ON f.tree_id = c.tree_id""", "metadata", "commits", "tree_entries"),
    "newest_metadata": with_catalog("""
SELECT id + CASE WHEN target_id % 3 = 0 THEN 2000000000000 ELSE 0 END AS id, target_id,
       CASE WHEN target_id % 3 = 0 THEN 'again_' ELSE '' END || json_extract_string(stats, '$.file_name') AS file_name
FROM metadata WHERE target_id > 0""", "metadata"),
    "version_by_id": with_catalog("""
SELECT id, target_id, json_extract_string(stats, '$.file_name') AS file_name FROM metadata
WHERE id = (SELECT max(id) FROM metadata WHERE target_id > 0)""", "metadata"),
    "commit_by_key": with_catalog("""
SELECT id, project_id, author_id, branch, message FROM commits WHERE id = (SELECT max(id) FROM commits)""",
        "commits"),
    "commit_metadata_view": with_catalog("""
SELECT c.id AS commit_id, c.message, c.branch, c.created_at AS committed_at, p.name AS project,
       json_extract_string(m.stats, '$.row_count') AS row_count,
       json_extract_string(m.stats, '$.file_name') AS file_name
FROM commits c JOIN projects p ON c.project_id = p.id LEFT JOIN metadata m ON m.target_id = c.id""",
        "commits", "projects", "metadata"),
    "commit_author": with_catalog("""
SELECT c.id, u.username AS author FROM commits c LEFT JOIN users u ON c.author_id = u.id""",
        "commits", "users"),
    "project_owner": with_catalog("""
SELECT p.id, p.name, u.username AS owner FROM projects p LEFT JOIN users u ON p.owner_id = u.id""",
        "projects", "users"),
    "list_projects": with_catalog("""
SELECT p.id, p.name, p.description, u.username AS owner,
       strftime(CAST(f.first_commit AS DATE), '%Y-%m-%d') AS created_at FROM projects p
LEFT JOIN users u ON p.owner_id = u.id
LEFT JOIN (SELECT project_id, min(created_at) AS first_commit FROM commits GROUP BY project_id) f
  ON f.project_id = p.id""", "projects", "users", "commits"),
    "new_projects": with_catalog("""
SELECT DISTINCT name FROM (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation)
WHERE name NOT IN (SELECT name FROM projects)""", "projects"),
    "distinct_refs": with_catalog("SELECT DISTINCT object_hash FROM tree_entries", "tree_entries"),
    "supported_extension": with_catalog("""
SELECT id, name, regexp_extract(lower(name), '(\\.[^./]+)$', 1) AS ext FROM tree_entries
WHERE regexp_extract(lower(name), '(\\.[^./]+)$', 1) IN ('.csv', '.json', '.parquet')""",
        "tree_entries"),
    "orphan_blobs": with_catalog(f"SELECT blob_hash, size_bytes FROM ({_ORPHANS})",
                                 "blobs", "tree_entries"),
    "orphans": with_catalog(f"""
SELECT blob_hash, size_bytes, origin, round(size_bytes / 1024.0, 1) AS size_kb FROM ({_ORPHANS})""",
        "blobs", "tree_entries"),
    "gc_summary": with_catalog(f"""
SELECT count(*) AS removed_blobs, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS removed_bytes
FROM ({_ORPHANS})""", "blobs", "tree_entries"),
    "storage_by_author": with_catalog(f"""
SELECT c.author_id, CAST(sum(b.size_bytes) AS BIGINT) AS used_bytes {_STORAGE_JOIN}
GROUP BY c.author_id""", "commits", "tree_entries", "blobs"),
    "storage_by_author_dedup": with_catalog(f"""
SELECT author_id, CAST(sum(size_bytes) AS BIGINT) AS used_bytes FROM (
  SELECT DISTINCT c.author_id, b.blob_hash, b.size_bytes {_STORAGE_JOIN}) GROUP BY author_id""",
        "commits", "tree_entries", "blobs"),
    "over_quota": with_catalog(f"""
SELECT author_id, used_bytes, round(used_bytes / 1048576.0, 1) AS used_mb FROM (
  SELECT c.author_id, CAST(sum(b.size_bytes) AS BIGINT) AS used_bytes {_STORAGE_JOIN}
  GROUP BY c.author_id) WHERE used_bytes > 104857600""", "commits", "tree_entries", "blobs"),
    "global_stats": with_catalog("""
SELECT (SELECT count(*) FROM commits) AS total_commits, (SELECT count(*) FROM blobs) AS total_blobs,
       (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM blobs) AS total_storage_bytes,
       (SELECT count(*) FROM metadata) AS total_indexed_files,
       (SELECT CAST(coalesce(sum(TRY_CAST(json_extract_string(stats, '$.row_count') AS BIGINT)), 0) AS BIGINT)
        FROM metadata) AS total_rows_indexed,
       (SELECT count(*) FROM projects) AS total_projects""", "commits", "blobs", "metadata", "projects"),
    "audit_with_user": with_catalog("""
SELECT a.id, u.username AS "user", a.action, a.record_id FROM audit_log a JOIN users u ON a.user_id = u.id""",
        "audit_log", "users"),
    "audit_tail": with_catalog(f"""
SELECT a.id, u.username AS "user", a.action, a.table_name, a.record_id, a.details,
       {iso_sql('a.performed_at')} AS performed_at
FROM audit_log a JOIN users u ON a.user_id = u.id ORDER BY a.performed_at DESC, a.id DESC LIMIT 100""",
        "audit_log", "users"),
    "open_pulls": with_catalog("""
SELECT id, project_id, title, source_branch, target_branch FROM pull_requests WHERE status = 'open'""",
        "pull_requests"),
}

# Recursive oracles: the CTE list must start with RECURSIVE.


def _rec(body: str, *names: str) -> str:
    ctes = ",\n".join(f"{n} AS ({CATALOG_SQL[n]})" for n in names)
    return f"WITH RECURSIVE {ctes},\n{body}"


ORACLE["hash_files"] = ("SELECT s_suppkey AS file_key, sha256(s_name || chr(10)) AS blob_hash, "
                        "CAST(octet_length(encode(s_name)) + 1 AS BIGINT) AS size_bytes FROM supplier")
ORACLE["commit_chain"] = _rec(CHAIN_SQL + "\nSELECT id, parent_hash, commit_hash FROM chain",
                              "commits", "tree_entries")
ORACLE["verify_chain"] = _rec(CHAIN_SQL + """
SELECT id, sha256(coalesce(parent_hash, '') || message || blob_hash) = commit_hash AS hash_ok,
       parent_hash IS NOT DISTINCT FROM lag(commit_hash) OVER (PARTITION BY project_id, branch ORDER BY rn) AS parent_ok
FROM (SELECT id, chain.project_id, chain.branch, chain.rn, commit_hash, c2.blob_hash,
             CASE WHEN id % 11 = 0 THEN c2.message || '!' ELSE c2.message END AS message,
             CASE WHEN id % 13 = 0 THEN 'forged' ELSE parent_hash END AS parent_hash
      FROM chain JOIN c AS c2 USING (id))""", "commits", "tree_entries")
ORACLE["ancestry"] = _rec(f"""
par AS ({PARENT_SQL}),
heads AS (SELECT arg_max(id, (created_at, id)) AS id FROM commits GROUP BY project_id, branch),
walk AS (
  SELECT h.id AS start_id, p.parent_id AS ancestor_id, 1 AS depth FROM heads h JOIN par p ON p.id = h.id
  WHERE p.parent_id IS NOT NULL
  UNION ALL
  SELECT w.start_id, p.parent_id, w.depth + 1 FROM walk w JOIN par p ON p.id = w.ancestor_id
  WHERE p.parent_id IS NOT NULL)
SELECT start_id, ancestor_id, CAST(depth AS BIGINT) AS depth FROM walk""", "commits")
ORACLE["project_log_records"] = _rec(CHAIN_SQL + f"""
SELECT p.name AS project, c2.id AS commit_id, h.commit_hash, h.parent_hash, c2.message, c2.branch, u.username AS author,
       {iso_sql('c2.created_at')} AS created_at, coalesce(m.records, 0) AS records, coalesce(m.file_names, '') AS file_names,
       coalesce(m.n, 0) AS rows, m.loss
FROM commits c2 JOIN projects p ON c2.project_id = p.id LEFT JOIN chain h ON h.id = c2.id LEFT JOIN users u ON u.id = c2.author_id
LEFT JOIN (SELECT target_id, count(*) AS records, string_agg(json_extract_string(stats, '$.file_name'), ',') AS file_names,
                  CAST(sum(TRY_CAST(json_extract_string(stats, '$.row_count') AS BIGINT)) AS BIGINT) AS n,
                  min(TRY_CAST(json_extract_string(stats, '$.custom_metrics.loss') AS DOUBLE)) AS loss
           FROM metadata GROUP BY target_id) m ON m.target_id = c2.id
WHERE p.name = '{LOG_PROJECT}'""", "commits", "tree_entries", "projects", "users", "metadata")
