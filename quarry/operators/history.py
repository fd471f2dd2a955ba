"""History over stored parent pointers: branches that fork, any depth, without walking step by step.

A commit has one parent, but a parent may have several children (a branch that
starts from a commit of another one), so root and depth alone do not tell
ancestors from siblings.  The *lifting table* holds, for every commit, its
ancestor 1, 2, 4, 8, ... steps up; it is built by joining each level with
itself, ceil(log2(depth)) joins for the whole history.  Every depth is a sum
of distinct powers of two, so all ancestors of some commits come from one join
per level, each ancestor exactly once.  Levels are written (reliable
checkpoints); hot ancestors are skewed join keys that adaptive execution can
split, because both sides are read from written data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.lineage import parent_commits
from quarry.session import ensure_checkpoint_dir

MOST_LEVELS = 63


def forked_parents(commits: DataFrame) -> DataFrame:
    """(id, parent_id): the previous commit of the branch; a branch's first commit
    forks from the newest earlier commit of the project's first branch (by name).

    The fork points are an as-of lookup: one maximum per branch.
    """
    chain = parent_commits(commits)
    at = F.struct("created_at", "id")
    starts = commits.groupBy("project_id", "branch").agg(F.min(at).alias("start"))
    trunk = starts.groupBy("project_id").agg(F.min("branch").alias("trunk"))
    others = starts.join(trunk, "project_id").where("branch <> trunk").select("project_id", "trunk", "start")
    line = commits.join(trunk, "project_id").where("branch = trunk").select(F.col("project_id").alias("p"), at.alias("at"))
    forks = (others.join(line, (F.col("project_id") == F.col("p")) & (F.col("at") < F.col("start")))
             .groupBy(F.col("start.id").alias("id")).agg(F.max("at")["id"].alias("fork_id")))
    return chain.join(forks, "id", "left").select("id", F.coalesce("parent_id", "fork_id").alias("parent_id"))


def lifting_table(parents: DataFrame) -> DataFrame:
    """(level, id, ancestor_id): the ancestor 2**level steps above each commit that has one.

    ``parents(id, parent_id)``: null or unknown parents end the history.  A
    cycle would never end and raises ValueError.
    """
    ensure_checkpoint_dir(parents.sparkSession)
    known = parents.select(F.col("id").alias("parent_id"))
    level = (parents.where(F.col("parent_id").isNotNull()).join(known, "parent_id", "left_semi")
             .select("id", F.col("parent_id").alias("ancestor_id")).checkpoint())
    out = level.select(F.lit(0).alias("level"), "id", "ancestor_id")
    for k in range(1, MOST_LEVELS):
        onward = level.select(F.col("id").alias("ancestor_id"), F.col("ancestor_id").alias("next"))
        level = level.join(onward, "ancestor_id").select("id", F.col("next").alias("ancestor_id")).checkpoint()
        if level.isEmpty():
            return out
        out = out.unionByName(level.select(F.lit(k).alias("level"), "id", "ancestor_id"))
        if k > 40:  # 2**40 steps: more than any history has
            raise ValueError("parent pointers form a cycle")
    return out


def ancestors(lifting: DataFrame, of: DataFrame, itself: bool = False) -> DataFrame:
    """(start_id, ancestor_id, depth) of the commits in ``of`` (column ``id``)."""
    reached = of.select(F.col("id").alias("start_id"), F.col("id").alias("ancestor_id"), F.lit(0).cast("long").alias("depth")).distinct()
    levels = lifting.agg(F.max("level")).first()[0]
    for k in range(0 if levels is None else levels + 1):
        step = lifting.where(F.col("level") == k).select(F.col("id").alias("ancestor_id"), F.col("ancestor_id").alias("next"))
        further = reached.join(step, "ancestor_id").select("start_id", F.col("next").alias("ancestor_id"), (F.col("depth") + (1 << k)).alias("depth"))
        reached = reached.unionByName(further).checkpoint()
    return reached if itself else reached.where("depth > 0")


def state_at_commits(lifting: DataFrame, commits: DataFrame, entries: DataFrame, of: DataFrame) -> DataFrame:
    """G8 by commit: (start_id, name, object_hash, commit_id): for each commit in ``of``
    the files of its own history, each as the nearest commit left it."""
    line = ancestors(lifting, of, itself=True).join(commits.select(F.col("id").alias("ancestor_id"), "tree_id"), "ancestor_id")
    held = line.join(entries.select("tree_id", "name", "object_hash"), "tree_id")
    best = F.min_by(F.struct("object_hash", "ancestor_id"), "depth")
    return (held.groupBy("start_id", "name").agg(best.alias("b"))
            .select("start_id", "name", F.col("b.object_hash").alias("object_hash"), F.col("b.ancestor_id").alias("commit_id")))


# -- reference counts ---------------------------------------------------------

def _count_by_hash(entries: DataFrame, out: str) -> DataFrame:
    """(blob_hash, <out>): entries of each hash.  Hex digests are moved as their bytes, half as long; other texts as they are."""
    c = F.col("object_hash")
    digest = c.rlike("^[0-9a-f]{64}$")
    n = (entries.select(F.when(digest, F.unhex(c)).otherwise(c.cast("binary")).alias("k"), digest.alias("digest"))
         .groupBy("k", "digest").agg(F.count(F.lit(1)).alias(out)))
    return n.select(F.when(F.col("digest"), F.lower(F.hex("k"))).otherwise(F.col("k").cast("string")).alias("blob_hash"), out)


def reference_counts(blobs: DataFrame, entries: DataFrame) -> DataFrame:
    """(blob_hash, size_bytes, refs): how many entries hold each registered blob; zero when none does."""
    held = _count_by_hash(entries, "n")
    return blobs.join(held, "blob_hash", "left").select("blob_hash", "size_bytes", F.coalesce("n", F.lit(0)).cast("long").alias("refs"))


def update_counts(counts: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None,
                  new_blobs: DataFrame | None = None) -> DataFrame:
    """``counts`` after some entries (column ``object_hash``) came and went.

    Only the changes are aggregated; entries that stay are not read again.
    ``new_blobs(blob_hash, size_bytes)`` are registered with no reference.
    """
    parts = [counts.select("blob_hash", "size_bytes", "refs")]
    if new_blobs is not None:
        parts.append(new_blobs.join(counts.select("blob_hash"), "blob_hash", "left_anti")
                     .select("blob_hash", "size_bytes", F.lit(0).cast("long").alias("refs")).dropDuplicates(["blob_hash"]))
    for part, sign in ((added, 1), (removed, -1)):
        if part is not None:
            parts.append(_count_by_hash(part, "n").select("blob_hash", F.lit(None).cast("long").alias("size_bytes"), (F.col("n") * sign).alias("refs")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return (whole.groupBy("blob_hash").agg(F.max("size_bytes").alias("size_bytes"), F.sum("refs").alias("refs"))
            .where(F.col("size_bytes").isNotNull()))


def unreferenced(counts: DataFrame) -> DataFrame:
    """Blobs that may go: their count has come down to zero."""
    return counts.where("refs <= 0").select("blob_hash", "size_bytes")
