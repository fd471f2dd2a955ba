"""The batch upload path against a hand-made catalog."""

import hashlib
import json

from pyspark.sql import functions as F

from quarry.operators.push import push

MIB = 1024 * 1024


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_push_quota_dedup_chain_and_audit(spark):
    ts = lambda d: F.make_timestamp_ntz(F.lit(2021), F.lit(1), F.lit(d), F.lit(0), F.lit(0), F.lit(0))
    head = _h("m0" + "b0")
    commits = spark.createDataFrame(
        [(1, 1, 7, "main", 1, 1, head), (2, 1, 9, "main", 1, 2, _h("x"))],
        "id long, project_id int, author_id long, branch string, d int, tree_id long, commit_hash string"
    ).withColumn("created_at", ts(F.col("d"))).drop("d")
    # author 9 already stores 150 MiB -> over quota; commit 2 is older by id tie-break
    commits = commits.withColumn("created_at", F.when(F.col("id") == 2, ts(F.lit(0) + 1))
                                 .otherwise(ts(F.lit(2))))
    entries = spark.createDataFrame([(10, 1, "a.csv", "b0"), (20, 2, "big.csv", "big")],
                                    "id long, tree_id long, name string, object_hash string")
    blobs = spark.createDataFrame([("b0", 10), ("big", 150 * MIB)], "blob_hash string, size_bytes long")
    uploads = spark.createDataFrame(
        [(1, "b1", 5, "x.csv", 1, "main", 7, "m1", 3), (2, "b0", 10, "y.csv", 1, "main", 7, "m2", 4),
         (3, "b1", 5, "z.csv", 2, "dev", 7, "m3", 5), (4, "b9", 1, "w.csv", 1, "main", 9, "m4", 6)],
        "seq long, blob_hash string, size_bytes long, file_name string, project_id int, "
        "branch string, author_id long, message string, d int").withColumn(
        "created_at", ts(F.col("d"))).drop("d")
    out = push(uploads, commits, entries, blobs)
    assert [r["seq"] for r in out["rejected"].collect()] == [4]
    got = {r["seq"]: r for r in out["commits"].collect()}
    assert {s: got[s]["is_duplicate"] for s in got} == {1: False, 2: True, 3: True}
    h1 = _h(head + "m1" + "b1")
    assert (got[1]["parent_hash"], got[1]["commit_hash"]) == (head, h1)
    assert (got[2]["parent_hash"], got[2]["commit_hash"]) == (h1, _h(h1 + "m2" + "b0"))
    assert (got[3]["parent_hash"], got[3]["commit_hash"]) == (None, _h("m3" + "b1"))
    assert got[1]["tree_hash"] == _h(json.dumps({"x.csv": "b1"}, sort_keys=True))
    assert [(r["blob_hash"], r["first_seq"]) for r in out["new_blobs"].collect()] == [("b1", 1)]
    audit = {r["record_id"]: json.loads(r["details"]) for r in out["audit"].collect()}
    assert audit[h1] == {"file": "x.csv", "project": 1, "is_duplicate": False, "indexing": "background"}
