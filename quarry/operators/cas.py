"""Content addressing: hashes, dedup, tree manifests, commit chains.

Hashes are lowercase hex SHA-256 (``sha2(x, 256)``).  Everything is a
row-local expression or an aggregate except the commit chain, whose hash of a
commit needs the hash of its parent: a fold that is sequential within one
(project, branch) chain.  That fold streams each chain in order through
``mapInPandas`` (constant memory, chains spread over tasks); verification of a
stored chain is fully parallel.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.ordered import lag_in_group
from quarry.session import ensure_checkpoint_dir, shuffle_partitions


def content_hash(df: DataFrame, cols: str | list[str], out: str = "content_hash") -> DataFrame:
    """H1 (row level): SHA-256 of a text/binary column, or of the JSON text of
    several columns (field names and NULLs included, so it is unambiguous)."""
    if isinstance(cols, str):
        return df.withColumn(out, F.sha2(F.col(cols), 256))
    doc = F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})
    return df.withColumn(out, F.sha2(doc, 256))


def table_fingerprint(df: DataFrame, hash_col: str) -> DataFrame:
    """H1 (table level): an order-independent fingerprint of a set of row hashes.

    ``count`` plus the exact sum of the first 60 bits of every row hash: an
    additive form, so it is a plain partial/final aggregate (no collect of the
    hashes, no sort).
    """
    part = F.conv(F.substring(F.col(hash_col), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part).cast("string").alias("hash_sum"))


def first_occurrence(uploads: DataFrame, hash_col: str, seq_col: str) -> DataFrame:
    """The first upload (smallest ``seq_col``) of each hash writes the blob.

    An aggregate (skew-safe: partial per task) joined back on the hash; a hot
    hash is a skewed sort-merge-join key that AQE splits.
    """
    firsts = uploads.groupBy(hash_col).agg(F.min(seq_col).alias("first_seq"))
    return (uploads.join(firsts, hash_col, "inner")
                   .withColumn("is_duplicate", F.col(seq_col) > F.col("first_seq")))


def dedup_blobs(batch: DataFrame, registry: DataFrame, hash_col: str = "blob_hash",
                size_col: str = "size_bytes", seq_col: str = "seq") -> DataFrame:
    """H2: blobs to add to the registry: distinct batch hashes not yet stored.

    One row per new hash with its first upload, size and number of copies.
    """
    new = (batch.groupBy(hash_col)
                .agg(F.min(seq_col).alias("first_seq"), F.min(size_col).alias(size_col),
                     F.count(F.lit(1)).alias("copies")))
    return new.join(registry.select(hash_col), hash_col, "left_anti")


def is_duplicate_blob(batch: DataFrame, registry: DataFrame, hash_col: str = "blob_hash") -> DataFrame:
    """Existence probe of every batch hash in a registry (left semi as a flag)."""
    reg = registry.select(hash_col).distinct().withColumn("__hit", F.lit(True))
    return (batch.join(reg, hash_col, "left")
                 .withColumn("is_duplicate", F.coalesce(F.col("__hit"), F.lit(False)))
                 .drop("__hit"))


def dedup_savings(uploads: DataFrame, hash_col: str, size_col: str) -> DataFrame:
    """H3: logical bytes of all uploads vs bytes stored once per distinct hash."""
    per_hash = uploads.groupBy(hash_col).agg(F.count(F.lit(1)).alias("n"),
                                             F.min(size_col).alias("sz"))
    return per_hash.agg(
        F.sum(F.col("n")).alias("uploads"),
        F.count(F.lit(1)).alias("distinct_blobs"),
        F.sum(F.col("n") * F.col("sz")).alias("logical_bytes"),
        F.sum("sz").alias("stored_bytes")).withColumn(
        "saved_bytes", F.col("logical_bytes") - F.col("stored_bytes"))


TREE_SCHEMA = "tree_id long, tree_hash string, entries long"


def _fold_trees(tree_col, name_col, object_col):
    """Hash ``{"name": "hash", ...}`` (keys sorted, json.dumps spacing and
    escapes) for every tree while its entries stream by in name order."""
    def emit(tree, h, n):
        h.update(b"}")
        return tree, h.hexdigest(), n

    def fold(batches):
        cur, h, n = None, None, 0
        for pdf in batches:
            out = []
            for tree, name, obj in zip(pdf[tree_col], pdf[name_col], pdf[object_col]):
                if h is None or tree != cur:
                    if h is not None:
                        out.append(emit(cur, h, n))
                    cur, h, n = tree, hashlib.sha256(b"{"), 0
                if n:
                    h.update(b", ")
                h.update((json.dumps(name) + ": " + json.dumps(obj)).encode("utf-8"))
                n += 1
            if out:
                yield pd.DataFrame(out, columns=["tree_id", "tree_hash", "entries"])
        if h is not None:
            yield pd.DataFrame([emit(cur, h, n)], columns=["tree_id", "tree_hash", "entries"])
    return fold


def tree_hash(entries: DataFrame, tree_col: str = "tree_id", name_col: str = "name",
              object_col: str = "object_hash") -> DataFrame:
    """H4: SHA-256 of the manifest text ``{"name": "hash", ...}`` sorted by name.

    A hash of a sorted text is a sequential fold, so entries are partitioned
    by tree, sorted by (tree, name) within partitions and hashed while the
    Arrow batches stream by: constant memory, whatever a tree's size, and
    trees in parallel.  Returns (tree_id, tree_hash, entries).
    """
    src = entries.select(F.col(tree_col).cast("long").alias("tree_id"),
                         F.col(name_col).alias("name"), F.col(object_col).alias("object_hash"))
    ordered = src.repartition("tree_id").sortWithinPartitions("tree_id", "name")
    return ordered.mapInPandas(_fold_trees("tree_id", "name", "object_hash"), TREE_SCHEMA)


def first_tree_entry(entries: DataFrame, tree_col: str = "tree_id", id_col: str = "id",
                     object_col: str = "object_hash", name_col: str = "name") -> DataFrame:
    """The first entry (smallest id) of every tree, as an aggregate."""
    best = F.min_by(F.struct(F.col(id_col).alias("id"), F.col(name_col).alias("name"),
                             F.col(object_col).alias("object_hash")), F.col(id_col))
    return (entries.groupBy(tree_col).agg(best.alias("e"))
                   .select(tree_col, F.col("e.id").alias("entry_id"), F.col("e.name").alias("name"),
                           F.col("e.object_hash").alias("object_hash")))


CHAIN_SCHEMA = "id long, parent_hash string, commit_hash string"


def _fold_chains(group_cols, message_col, blob_col, start_col=None):
    def fold(batches):
        last_key, last_hash = None, None
        for pdf in batches:
            keys = list(zip(*[pdf[g] for g in group_cols])) if group_cols else [()] * len(pdf)
            starts = pdf[start_col] if start_col else [None] * len(pdf)
            parents, hashes = [], []
            for key, msg, blob, start in zip(keys, pdf[message_col], pdf[blob_col], starts):
                if key != last_key:
                    last_key = key
                    last_hash = start if isinstance(start, str) and start else None
                text = (last_hash or "") + (msg or "") + (blob or "")
                parents.append(last_hash)
                last_hash = hashlib.sha256(text.encode("utf-8")).hexdigest()
                hashes.append(last_hash)
            yield pd.DataFrame({"id": pdf["id"].astype("int64"), "parent_hash": parents,
                                "commit_hash": hashes})
    return fold


def commit_chain(commits: DataFrame, group_cols=("project_id", "branch"),
                 order_cols=("created_at", "id"), message_col: str = "message",
                 blob_col: str = "blob_hash", start_col: str | None = None) -> DataFrame:
    """H5: ``commit_hash = sha256(parent_hash || message || blob_hash)`` per chain.

    A chain is the commits of one (project, branch) in (created_at, id) order;
    the root has parent '' in the hash input and NULL as parent, unless
    ``start_col`` gives the hash an appended chain continues from (the same
    value on every row of that chain, e.g. the current branch head).  Chains are
    hash-partitioned, sorted within partitions and folded while streaming the
    Arrow batches of each partition.  Returns (id, parent_hash, commit_hash).
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    src = commits.select(*group_cols, *[c for c in order_cols if c not in group_cols],
                         *([] if "id" in order_cols else ["id"]), message_col, blob_col,
                         *([start_col] if start_col else []))
    # Partitioned by chain without a fixed count, so AQE can coalesce small
    # partitions (fewer Python workers on small data) and keep many on big.
    ordered = src.repartition(*group_cols).sortWithinPartitions(*group_cols, *order_cols)
    return ordered.mapInPandas(_fold_chains(group_cols, message_col, blob_col, start_col),
                               CHAIN_SCHEMA)


def verify_chain(stored: DataFrame, group_cols=("project_id", "branch"),
                 order_cols=("created_at", "id"), message_col: str = "message",
                 blob_col: str = "blob_hash") -> DataFrame:
    """H6: recompute every stored commit hash and check every parent link.

    Fully parallel: the hash check is row-local; the expected parent is the
    previous commit of the chain (a skew-safe lag, see plans.ordered).
    Returns (id, hash_ok, parent_ok).
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    recomputed = F.sha2(F.concat(F.coalesce(F.col("parent_hash"), F.lit("")),
                                 F.coalesce(F.col(message_col), F.lit("")),
                                 F.coalesce(F.col(blob_col), F.lit(""))), 256)
    with_prev = lag_in_group(stored, group_cols, order_cols, ["commit_hash"], prefix="expected_")
    return with_prev.select(
        "id",
        (recomputed == F.col("commit_hash")).alias("hash_ok"),
        F.col("parent_hash").eqNullSafe(F.col("expected_commit_hash")).alias("parent_ok"))


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _empty_files(spark, path: str) -> list[str]:
    """Paths of zero-length files at or below the path or glob (file statuses only)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for top in fs.globStatus(where) or []:
        listing = fs.listFiles(top.getPath(), True)
        while listing.hasNext():
            st = listing.next()
            if st.getLen() == 0 and st.getPath().getName()[0] not in "._":  # as Spark's readers skip them
                out.append(st.getPath().toString())
    return out


def _empty_below(deep: bool):
    """Folders in, (path, folder?) of zero-length files out, and of sub-folders unless ``deep`` goes through them."""
    def run(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            todo, out = ["/" + p[5:].lstrip("/") for p in batch.column(0).to_pylist()], []
            while todo:
                with os.scandir(todo.pop()) as entries:
                    for e in entries:
                        if e.is_dir():
                            todo.append(e.path) if deep else out.append((f"file:{e.path}", True))
                        elif e.name[0] not in "._" and e.stat().st_size == 0:
                            out.append((f"file:{e.path}", False))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([d for _, d in out], pa.bool_())], ["path", "folder"])
    return run


def _empty_local_files(spark, path: str) -> DataFrame:
    """:func:`_empty_files` of a file system that tasks see: they walk a folder each, the driver only resolves the path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tops = [(st.getPath().toString(), st.isDirectory(), st.getLen()) for st in fs.globStatus(where) or []]
    kind = "path string, folder boolean"
    files = spark.createDataFrame([(p, False) for p, d, size in tops if not d and size == 0 and p.rsplit("/", 1)[1][0] not in "._"], kind)
    level = spark.createDataFrame([(p,) for p, d, _ in tops if d], "path string").mapInArrow(_empty_below(False), kind).checkpoint()
    below = (level.where("folder").select("path").repartition(shuffle_partitions(spark)).mapInArrow(_empty_below(True), kind))
    return files.unionByName(level.where("not folder")).unionByName(below).select("path")


HASH_CHUNK = 8 << 20


def _chunk_hasher(chunk: int):
    """Paths in, (path, hash, bytes read) out; a file passes through memory ``chunk`` bytes at a time.

    Returned as a closure, so that tasks need no import of this package.
    """
    def opened(path):
        if path.startswith("file:"):
            return open("/" + path[5:].lstrip("/"), "rb")
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        return where.open_input_stream(name)

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                digest, size = hashlib.sha256(), 0
                with opened(path) as f:
                    while part := f.read(chunk):
                        digest.update(part)
                        size += len(part)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()]), pa.array([size], pa.int64())], ["path", "blob_hash", "size_bytes"])
    return run


def _readable_in_chunks(path: str) -> bool:
    """Whether tasks can open files of this scheme themselves (local or mounted, or a store that Arrow knows)."""
    scheme = path.split(":", 1)[0] if "://" in path or path.startswith("file:") else "file"
    return scheme in ("file", "s3", "gs", "gcs", "abfs", "abfss")


def hash_files(spark, path: str, chunk: int = HASH_CHUNK) -> DataFrame:
    """SHA-256 and byte size of every file at or below a path or glob.

    The listing is Spark's (names and lengths only, large files in a partition
    of their own); each file then passes through a running hash in chunks, so
    its size does not matter.  Spark lists no zero-length files: those are
    taken from the file statuses with the hash of no bytes, by tasks where they
    see the files (the driver asks one status at a time).  In a store that
    only Spark's readers open, files are hashed as binary values, which ends at
    2 GB a file.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    whole = path if ":" in path else spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if _readable_in_chunks(whole):
        files = listed.select("path").mapInArrow(_chunk_hasher(chunk), "path string, blob_hash string, size_bytes long")
    else:
        files = listed.select("path", F.sha2(F.col("content"), 256).alias("blob_hash"), F.col("length").alias("size_bytes"))
    if whole.startswith("file:"):
        ensure_checkpoint_dir(spark)
        return files.unionByName(_empty_local_files(spark, path).select("path", F.lit(EMPTY_SHA256).alias("blob_hash"), F.lit(0).cast("long").alias("size_bytes")))
    empty = _empty_files(spark, path)
    if empty:
        extra = spark.createDataFrame([(p, EMPTY_SHA256, 0) for p in empty],
                                      "path string, blob_hash string, size_bytes long")
        files = files.unionByName(extra)
    return files
