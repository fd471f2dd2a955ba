"""Version-catalog operators: logs, joins, heads, ancestry, state, compare, GC.

All are DataFrame -> DataFrame and lazy.  Joins are left to the optimizer:
catalog tables whose size grows with the data (users, commits, metadata,
blobs) are never force-broadcast - AQE converts a join to a broadcast at run
time when the measured side is small, and splits skewed sort-merge partitions
otherwise.  Per-key "latest"/"first" choices are aggregates (``max_by`` /
``min_by``), which pre-aggregate per task and stay skew-safe.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.metricql import metric_predicate, metrics_map
from quarry.functions.text import iso, to_mb
from quarry.operators.cas import first_tree_entry
from quarry.operators.metric_index import FIELDS, is_indexed, metric_condition
from quarry.plans.ordered import lag_in_group, row_index_in_group
from quarry.session import ensure_checkpoint_dir

QUOTA_BYTES = 100 * 1024 * 1024


def json_field(stats_col: str, path: str):
    return F.get_json_object(F.col(stats_col), f"$.{path}")


def record_field(records: DataFrame, name: str):
    """A field of metadata records: the typed column of an index, else read from the JSON text."""
    if name in records.columns:
        return F.col(name)
    value = json_field("stats", name)
    return (value if FIELDS[name] == "string" else value.try_cast(FIELDS[name])).alias(name)


def with_metric(records: DataFrame, metric: str | None) -> DataFrame:
    """Records that pass a metric filter; by pushed-down comparisons on an index, else on the JSON text."""
    if is_indexed(records):
        return records.where(metric_condition(records, metric))
    return records.where(metric_predicate(metric, metrics_map(F.col("stats")), parsed=True))


def commits_with_blob(commits: DataFrame, entries: DataFrame) -> DataFrame:
    """Commit rows plus the object hash of their tree's first entry ('' when none)."""
    first = first_tree_entry(entries).select(F.col("tree_id"), F.col("object_hash").alias("blob_hash"))
    return (commits.join(first, "tree_id", "left")
                   .withColumn("blob_hash", F.coalesce("blob_hash", F.lit(""))))


def _try_ts(text: str | None):
    """ISO text -> datetime, None when it does not parse (C12: ignored)."""
    if text is None:
        return None
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        return None


def _ntz(ts: datetime):
    """Timestamp literal without time zone, built from ISO text so neither the
    Python process zone nor the session zone can shift it."""
    if ts.tzinfo is not None:  # stored times are UTC
        ts = ts.astimezone(timezone.utc)
    return F.lit(ts.replace(tzinfo=None).isoformat()).cast("timestamp_ntz")


def filter_log(commits: DataFrame, project_ids: DataFrame | None = None, branch: str | None = None,
               since: str | None = None, until: str | None = None) -> DataFrame:
    """F2 + F4: optional branch equality and inclusive time bounds."""
    out = commits
    if branch is not None:
        out = out.where(F.col("branch") == branch)
    lo, hi = _try_ts(since), _try_ts(until)
    if lo is not None:
        out = out.where(F.col("created_at") >= _ntz(lo))
    if hi is not None:
        out = out.where(F.col("created_at") <= _ntz(hi))
    return out


def project_log(commits: DataFrame, users: DataFrame, metadata: DataFrame, projects: DataFrame,
                project: str | None = None, branch: str | None = None, metric: str | None = None,
                since: str | None = None, until: str | None = None,
                drop_empty: bool = False, nested: bool = False, chain: DataFrame | None = None) -> DataFrame:
    """G1: commits of a project (all projects when ``project`` is None) with
    author name and the metadata records that pass the metric filter.

    ``drop_empty=False`` keeps every commit (records that fail the filter are
    left out: the reference's behaviour); ``drop_empty=True`` keeps only
    commits with a matching record (the documented behaviour, F8).  Flat
    output has one row per (commit, record or NULL); ``nested=True`` gathers the
    records of a commit into an array (one commit = few records, bounded).
    With ``chain(id, commit_hash, parent_hash)`` the log carries the hashes,
    and the records their metrics (JSON text).
    """
    proj = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    if project is not None:
        proj = proj.where(F.col("project") == project)
        if proj.limit(1).count() == 0:  # the reference answers 404 here
            raise LookupError(f"project not found: {project}")
    c = filter_log(commits.join(proj, "project_id", "inner"), branch=branch, since=since, until=until)
    authors = users.select(F.col("id").alias("author_id"), F.col("username").alias("author"))
    c = c.join(authors, "author_id", "left")
    hashes, more = [], []
    if chain is not None:
        hashes, more = ["commit_hash", "parent_hash"], ["custom_metrics"]
        c = c.join(chain.select("id", *hashes), "id", "left")
    md = (with_metric(metadata, metric)
          .select(F.col("target_id").alias("id"), F.col("id").alias("metadata_id"),
                  *[record_field(metadata, c) for c in ("file_name", "row_count", "column_count")],
                  *[json_field("stats", c).alias(c) for c in more]))
    how = "inner" if drop_empty else "left"
    flat = c.join(md, "id", how).select(
        "project", F.col("id").alias("commit_id"), *hashes, "message", "branch", "author",
        iso(F.col("created_at")).alias("created_at"), F.col("created_at").alias("__ts"),
        "metadata_id", "file_name", "row_count", "column_count", *more)
    if not nested:
        # L1: newest first (commit id breaks ties between equal times).
        return flat.orderBy(F.col("__ts").desc(), F.col("commit_id").desc(),
                            F.col("metadata_id")).drop("__ts")
    rec = F.struct("metadata_id", "file_name", "row_count", "column_count", *more)
    return (flat.groupBy("project", "commit_id", *hashes, "message", "branch", "author", "created_at", "__ts")
                .agg(F.filter(F.collect_list(rec), lambda r: r["metadata_id"].isNotNull())
                     .alias("metadata"))
                .orderBy(F.col("__ts").desc(), F.col("commit_id").desc())
                .drop("__ts"))


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """the row(s) whose ``column`` equals ``value``; LookupError when there
    is none (the reference answers 404).  A filter pushed into the scan and a
    one-row probe."""
    hit = df.where(F.col(column) == F.lit(value))
    if hit.limit(1).count() == 0:
        raise LookupError(f"{column} = {value!r} not found")
    return hit


def newest_records(records: DataFrame, by: str, time: str = "indexed_at", tie: str = "id") -> DataFrame:
    """The newest record of each ``by`` (the larger ``tie`` among equal times): one aggregate, no window."""
    whole = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    return (records.groupBy(by).agg(F.max_by(whole, F.struct(time, tie)).alias("__r")).select("__r.*"))


def parent_commits(commits: DataFrame) -> DataFrame:
    """The parent of a commit is the previous commit of its (project, branch)
    in (created_at, id) order; skew-safe lag."""
    return (lag_in_group(commits.select("id", "project_id", "branch", "created_at"),
                         ["project_id", "branch"], ["created_at", "id"], ["id"], prefix="parent_")
            .select("id", "parent_id"))


def commit_parent(commits: DataFrame) -> DataFrame:
    """Self join of a commit with its parent."""
    par = parent_commits(commits)
    p = commits.select(F.col("id").alias("parent_id"), F.col("message").alias("parent_message"),
                       F.col("created_at").alias("parent_created_at"))
    return (par.join(p, "parent_id", "left")
               .select("id", "parent_id", "parent_message"))


def branch_heads(commits: DataFrame) -> DataFrame:
    """Newest commit and commit count of every (project, branch)."""
    return (commits.groupBy("project_id", "branch")
                   .agg(F.max_by("id", F.struct("created_at", "id")).alias("head_id"),
                        F.count(F.lit(1)).alias("commits")))


def ancestry(commits: DataFrame, of: DataFrame) -> DataFrame:
    """Every ancestor of the commits in ``of`` (column ``id``) with depth.

    Chains are linear (one parent per commit, parent = previous commit of the
    branch), so depth is a difference of positions: positions come from the
    skew-safe row index and ancestors are the earlier positions of the same
    chain - a join on (project, branch) filtered by position, with the
    requested commits on the small side.  No recursion, one pass.
    """
    pos = row_index_in_group(commits.select("id", "project_id", "branch", "created_at"),
                             ["project_id", "branch"], ["created_at", "id"], out="pos")
    start = (of.select("id").join(pos, "id", "inner")
               .select(F.col("id").alias("start_id"), "project_id", "branch",
                       F.col("pos").alias("start_pos")))
    anc = pos.join(start, ["project_id", "branch"], "inner").where(F.col("pos") < F.col("start_pos"))
    return anc.select("start_id", F.col("id").alias("ancestor_id"),
                      (F.col("start_pos") - F.col("pos")).alias("depth"))


def rank_by_pointers(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, root_id, depth) for parent pointers ``edges(id, parent_id)``
    (NULL parent = root), by pointer jumping.

    Every node keeps a pointer to its farthest known ancestor and the
    distance to it; each round replaces the pointer by the pointer of the
    node it points to, so a chain of length L is resolved in ceil(log2 L)
    rounds.  A round is one equi-join on the node id (unique on the looked-up
    side; a pointer target shared by many nodes is a skewed key that AQE
    splits) and ends with a reliable checkpoint.  The only driver-side work is
    counting the unresolved nodes after each round.  A node whose parent is
    missing from the table is the root of its (broken) chain.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    # A parent that is not in the table ends its chain: that node is a root.
    known = edges.select(F.col("id").alias("parent_id"), F.lit(True).alias("__known"))
    edges = (edges.join(known, "parent_id", "left")
                  .withColumn("parent_id", F.when(F.col("__known"), F.col("parent_id")))
                  .drop("__known"))
    state = edges.select(
        F.col("id"), F.col("parent_id").alias("nxt"),
        F.when(F.col("parent_id").isNull(), F.col("id")).alias("root_id"),
        F.when(F.col("parent_id").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("d"))
    state = state.checkpoint(eager=True)
    for _ in range(max_rounds):
        if state.where(F.col("root_id").isNull()).limit(1).count() == 0:
            return state.select("id", "root_id", F.col("d").alias("depth"))
        other = state.select(F.col("id").alias("o_id"), F.col("nxt").alias("o_nxt"),
                             F.col("root_id").alias("o_root"), F.col("d").alias("o_d"))
        j = state.join(other, state.nxt == other.o_id, "left")
        done = F.col("root_id").isNotNull()
        hit_root = F.col("o_root").isNotNull()
        state = j.select(
            "id",
            F.when(done | hit_root, F.lit(None).cast(state.schema["nxt"].dataType))
             .otherwise(F.col("o_nxt")).alias("nxt"),
            F.when(done, F.col("root_id")).otherwise(F.col("o_root")).alias("root_id"),
            F.when(done, F.col("d")).otherwise(F.col("d") + F.col("o_d")).alias("d"),
        ).checkpoint(eager=True)
    raise RuntimeError("parent pointers did not resolve (cycle or deeper than 2^max_rounds)")


def ancestry_by_pointers(edges: DataFrame, of: DataFrame) -> DataFrame:
    """G2 for stored parent pointers: (start_id, ancestor_id, depth) for the
    commits in ``of``.  Chains are linear (one parent, one child per branch),
    so the ancestors of a commit are the commits with the same root and a
    smaller depth; depth comes from :func:`rank_by_pointers`."""
    ranks = rank_by_pointers(edges)
    start = (of.select("id").join(ranks, "id", "inner")
               .select(F.col("id").alias("start_id"), F.col("root_id"),
                       F.col("depth").alias("start_depth")))
    anc = ranks.join(start, "root_id", "inner").where(F.col("depth") < F.col("start_depth"))
    return anc.select("start_id", F.col("id").alias("ancestor_id"),
                      (F.col("start_depth") - F.col("depth")).alias("depth"))


def state_at(commits: DataFrame, entries: DataFrame, as_of: str, branch: str | None = None) -> DataFrame:
    """For every (project, branch, file name) the object it had as of ``as_of``:
    the entry of the newest commit at or before that time (as-of by max_by)."""
    at = _try_ts(as_of)
    if at is None:
        raise ValueError(f"cannot read the time {as_of!r}")
    ts = _ntz(at)
    c = commits.where(F.col("created_at") <= ts)
    if branch is not None:
        c = c.where(F.col("branch") == branch)
    j = c.select("project_id", "branch", "tree_id", F.col("id").alias("commit_id"), "created_at") \
         .join(entries.select("tree_id", "name", "object_hash"), "tree_id", "inner")
    best = F.max_by(F.struct("object_hash", "commit_id"), F.struct("created_at", "commit_id"))
    return (j.groupBy("project_id", "branch", "name").agg(best.alias("b"))
             .select("project_id", "branch", "name", F.col("b.object_hash").alias("object_hash"),
                     F.col("b.commit_id").alias("commit_id")))


COMPARE_METRICS = ["mean", "max", "min", "null_pct", "unique_count"]


def compare_profiles(pa: DataFrame, pb: DataFrame) -> DataFrame:
    """Per column of either side: dtype_changed, row_count_diff (B-A)
    and B-A of mean, max, min, null_pct, unique_count where both exist, rounded 4.

    Profiles are long-form (one row per column), so the full outer join is on a
    table of schema width.
    """
    rows_a = pa.agg(F.max("row_count").alias("ra"))
    rows_b = pb.agg(F.max("row_count").alias("rb"))
    a = pa.select("column", F.col("dtype").alias("dtype_a"),
                  *[F.col(m).cast("double").alias(f"{m}_a") for m in COMPARE_METRICS])
    b = pb.select("column", F.col("dtype").alias("dtype_b"),
                  *[F.col(m).cast("double").alias(f"{m}_b") for m in COMPARE_METRICS])
    j = a.join(b, "column", "full_outer")
    # Row counts are one-row aggregates of each side, joined on a constant key.
    rc = rows_a.withColumn("__k", F.lit(1)).join(rows_b.withColumn("__k", F.lit(1)), "__k")
    j = j.withColumn("__k", F.lit(1)).join(F.broadcast(rc), "__k").drop("__k")
    diffs = [F.round(F.col(f"{m}_b") - F.col(f"{m}_a"), 4).alias(m) for m in COMPARE_METRICS]
    return j.select(
        "column",
        (~F.coalesce(F.col("dtype_a") == F.col("dtype_b"), F.lit(False))).alias("dtype_changed"),
        (F.coalesce(F.col("rb"), F.lit(0)) - F.coalesce(F.col("ra"), F.lit(0))).alias("row_count_diff"),
        *diffs)


def schema_sets(pa: DataFrame, pb: DataFrame) -> dict[str, DataFrame]:
    """U1-U3 over the column names of two profiles."""
    a = pa.select("column").distinct()
    b = pb.select("column").distinct()
    return {"union": a.unionByName(b).distinct(), "common": a.intersect(b),
            "added": b.exceptAll(a).distinct(), "removed": a.exceptAll(b).distinct()}


def orphan_blobs(blobs: DataFrame, entries: DataFrame) -> DataFrame:
    """Blobs that no tree entry references (anti join; object_hash is NOT NULL)."""
    refs = entries.select(F.col("object_hash").alias("blob_hash"))
    return blobs.join(refs, "blob_hash", "left_anti")


def gc_summary(orphans: DataFrame) -> DataFrame:
    """Number and bytes of removable blobs."""
    return orphans.agg(F.count(F.lit(1)).alias("removed_blobs"),
                       F.coalesce(F.sum("size_bytes"), F.lit(0).cast("long")).alias("removed_bytes"))


def storage_by_author(blobs: DataFrame, entries: DataFrame, commits: DataFrame,
                      dedup: bool = False) -> DataFrame:
    """Bytes per author over blob -> entry -> tree -> commit.

    ``dedup=False`` counts a blob once per referencing entry of every commit
    (the reference's quota query); ``dedup=True`` counts each distinct blob
    once per author.
    """
    j = (commits.select(F.col("author_id"), "tree_id")
                .join(entries.select("tree_id", F.col("object_hash").alias("blob_hash")), "tree_id")
                .join(blobs.select("blob_hash", "size_bytes"), "blob_hash"))
    if dedup:
        j = j.select("author_id", "blob_hash", "size_bytes").distinct()
    return j.groupBy("author_id").agg(F.sum("size_bytes").alias("used_bytes"))


def over_quota(usage: DataFrame, quota_bytes: int = QUOTA_BYTES) -> DataFrame:
    """Authors whose existing total is strictly above the quota."""
    return (usage.where(F.col("used_bytes") > quota_bytes)
                 .withColumn("used_mb", to_mb(F.col("used_bytes"))))


def global_stats(commits, blobs, metadata, projects) -> DataFrame:
    """Catalog counters in one row (one-row aggregates joined on a constant)."""
    parts = [
        commits.agg(F.count(F.lit(1)).alias("total_commits")),
        blobs.agg(F.count(F.lit(1)).alias("total_blobs"),
                  F.coalesce(F.sum("size_bytes"), F.lit(0).cast("long")).alias("total_storage_bytes")),
        metadata.agg(F.count(F.lit(1)).alias("total_indexed_files"),
                     F.coalesce(F.sum(json_field("stats", "row_count").try_cast("long")),
                                F.lit(0).cast("long")).alias("total_rows_indexed")),
        projects.agg(F.count(F.lit(1)).alias("total_projects")),
    ]
    out = parts[0].withColumn("__k", F.lit(1))
    for p in parts[1:]:
        out = out.join(F.broadcast(p.withColumn("__k", F.lit(1))), "__k")
    return out.drop("__k")


def resolve_blob(metadata: DataFrame, commits: DataFrame, entries: DataFrame) -> DataFrame:
    """Version -> commit -> tree -> first entry -> blob; a record that is
    not attached to a commit names its blob itself (target id as text)."""
    first = first_tree_entry(entries).select("tree_id", F.col("object_hash").alias("entry_blob"))
    c = commits.select(F.col("id").alias("target_id"), "tree_id").join(first, "tree_id", "left")
    return (metadata.select("id", "target_id").join(c, "target_id", "left")
                    .select("id", "target_id",
                            F.coalesce(F.col("entry_blob"), F.col("target_id").cast("string"))
                             .alias("blob_hash")))


def version_details(metadata: DataFrame, commits: DataFrame, projects: DataFrame,
                    entries: DataFrame) -> DataFrame:
    """Every version with its project name ('unknown' when missing) and its
    blob (J11), reading the metadata once: metadata -> commit -> project and
    commit -> tree -> first entry, all left joins."""
    first = first_tree_entry(entries).select("tree_id", F.col("object_hash").alias("entry_blob"))
    c = commits.select(F.col("id").alias("target_id"), "project_id", "tree_id")
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return (metadata.join(c, "target_id", "left").join(p, "project_id", "left")
                    .join(first, "tree_id", "left")
                    .withColumn("project_name", F.coalesce("project_name", F.lit("unknown")))
                    .withColumn("blob_hash", F.coalesce(F.col("entry_blob"),
                                                        F.col("target_id").cast("string"))))


def metadata_with_project(metadata: DataFrame, commits: DataFrame, projects: DataFrame) -> DataFrame:
    """Metadata -> commit -> project name, 'unknown' when missing."""
    c = commits.select(F.col("id").alias("target_id"), "project_id")
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return (metadata.join(c, "target_id", "left").join(p, "project_id", "left")
                    .withColumn("project_name", F.coalesce("project_name", F.lit("unknown"))))


def listing(metadata: DataFrame, commits: DataFrame, projects: DataFrame,
            project: str | None = None, file_type: str | None = None, limit: int | None = 50) -> DataFrame:
    """Metadata listing (project via J2 when given, type via F3),
    newest first; the limit is the feature (top-k)."""
    m = metadata_with_project(metadata, commits, projects)
    if project is not None:
        m = m.where(F.col("project_name") == project)
    if file_type is not None:
        m = m.where(record_field(metadata, "file_type") == file_type)
    out = m.select("id", "target_id", "project_name",
                   *[record_field(metadata, c) for c in ("file_name", "file_type", "row_count", "column_count")],
                   iso(F.col("indexed_at")).alias("indexed_at"), F.col("indexed_at").alias("__ts"))
    out = out.orderBy(F.col("__ts").desc(), F.col("id").desc())
    if limit is not None:
        out = out.limit(limit)
    return out.drop("__ts")


def audit_with_user(audit: DataFrame, users: DataFrame) -> DataFrame:
    """Audit rows with the user name; rows without a user vanish (inner)."""
    u = users.select(F.col("id").alias("user_id"), F.col("username").alias("user"))
    return audit.join(u, "user_id", "inner")


def audit_tail(audit: DataFrame, users: DataFrame, limit: int = 100) -> DataFrame:
    """Newest audit rows with user names (top-k)."""
    return (audit_with_user(audit, users)
            .orderBy(F.col("performed_at").desc(), F.col("id").desc()).limit(limit)
            .select("id", "user", "action", "table_name", "record_id", "details",
                    iso(F.col("performed_at")).alias("performed_at")))
