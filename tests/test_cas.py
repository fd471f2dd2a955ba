"""Content addressing: fixture hashes, dedup, chains and their verification."""

import hashlib
import os

from pyspark.sql import functions as F

from quarry.operators import cas


def test_tree_hash_fixture(spark):
    e = spark.createDataFrame([(1, "a.csv", "ff")], "tree_id int, name string, object_hash string")
    h = cas.tree_hash(e).collect()[0]["tree_hash"]
    assert h == "b5363a1db926fbe712ca1bc1b7c8e44dcf1d7aea094ab0e99b4c602a951746ab"


def test_tree_hash_sorts_by_name(spark):
    e = spark.createDataFrame([(1, "b", "2"), (1, "a b", "1"), (1, "a", "0")],
                              "tree_id int, name string, object_hash string")
    text = '{"a": "0", "a b": "1", "b": "2"}'
    assert cas.tree_hash(e).collect()[0]["tree_hash"] == hashlib.sha256(text.encode()).hexdigest()


def test_commit_chain_fixture(spark):
    c = spark.createDataFrame(
        [(1, 1, "main", 1, "m1", "b1"), (2, 1, "main", 2, "m2", "b2"), (3, 1, "dev", 3, "m1", "b1")],
        "id long, project_id int, branch string, created_at long, message string, blob_hash string")
    got = {r["id"]: (r["parent_hash"], r["commit_hash"]) for r in cas.commit_chain(c).collect()}
    h1 = "8e93738ff2dc996ca7a323388268e07aa11303f72f914fc2a3a703de15deda62"
    h2 = "4cd4073a3348b2de12af81e53ae27b0b0b632d1d468fdc2ead52e802fbdf5cd4"
    assert got[1] == (None, h1) and got[2] == (h1, h2) and got[3] == (None, h1)


def test_verify_chain_finds_exactly_the_tampered_row(spark):
    c = spark.createDataFrame(
        [(i, 1, "main", i, f"m{i}", f"b{i}") for i in range(1, 40)],
        "id long, project_id int, branch string, created_at long, message string, blob_hash string")
    stored = c.join(cas.commit_chain(c), "id")
    tampered = stored.withColumn("message", F.when(F.col("id") == 17, F.lit("evil"))
                                 .otherwise(F.col("message")))
    bad = cas.verify_chain(tampered).where(~F.col("hash_ok") | ~F.col("parent_ok")).collect()
    assert [r["id"] for r in bad] == [17]
    assert cas.verify_chain(stored).where(~F.col("hash_ok") | ~F.col("parent_ok")).count() == 0


def test_hash_files_matches_hashlib(spark, tmp_folder):
    want = {}
    for i, body in enumerate([b"alpha", b"beta" * 1000, b""]):
        p = os.path.join(tmp_folder, f"f{i}.bin")
        with open(p, "wb") as fh:
            fh.write(body)
        want[f"f{i}.bin"] = (hashlib.sha256(body).hexdigest(), len(body))
    got = {r["path"].rsplit("/", 1)[-1]: (r["blob_hash"], r["size_bytes"])
           for r in cas.hash_files(spark, f"{tmp_folder}/*.bin").collect()}
    assert got == want


def test_dedup_and_first_occurrence(spark):
    up = spark.createDataFrame([(1, "h1", 10), (2, "h2", 20), (3, "h1", 10)],
                               "seq int, blob_hash string, size_bytes long")
    occ = {r["seq"]: r["is_duplicate"] for r in cas.first_occurrence(up, "blob_hash", "seq").collect()}
    assert occ == {1: False, 2: False, 3: True}
    reg = spark.createDataFrame([("h2",)], "blob_hash string")
    new = cas.dedup_blobs(up, reg).collect()
    assert [(r["blob_hash"], r["first_seq"], r["copies"]) for r in new] == [("h1", 1, 2)]
    s = cas.dedup_savings(up, "blob_hash", "size_bytes").collect()[0]
    assert (s["logical_bytes"], s["stored_bytes"], s["saved_bytes"]) == (40, 30, 10)


def test_tree_hash_escapes_like_json_dumps(spark):
    import json
    entries = [(5, 'café "x".csv', "aa"), (5, "b.csv", "bb")]
    e = spark.createDataFrame(entries, "tree_id int, name string, object_hash string")
    text = json.dumps({n: h for _, n, h in entries}, sort_keys=True)
    assert cas.tree_hash(e).collect()[0]["tree_hash"] == hashlib.sha256(text.encode()).hexdigest()


def test_hash_files_below_folders(spark, tmp_folder):
    os.makedirs(f"{tmp_folder}/sub/deep")
    for name, data in (("empty.bin", b""), ("sub/none.bin", b""), ("sub/deep/one.bin", b"1")):
        with open(f"{tmp_folder}/{name}", "wb") as f:
            f.write(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["blob_hash"], r["size_bytes"]) for r in cas.hash_files(spark, tmp_folder).collect()}
    assert got == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in (("empty.bin", b""), ("none.bin", b""), ("one.bin", b"1"))}


def test_table_fingerprint_is_order_free_and_additive(spark):
    from quarry.operators.cas import content_hash, table_fingerprint

    def mark(rows):
        return table_fingerprint(content_hash(spark.createDataFrame([(r,) for r in rows], "t string"), "t"), "content_hash").first()
    a, b = ["x", "y", "y", ""], ["z", "x"]
    assert mark(a) == mark(a[::-1]) and mark(a) != mark(["x", "y", ""])
    assert int(mark(a + b).hash_sum) == int(mark(a).hash_sum) + int(mark(b).hash_sum) and mark(a + b).n_rows == 6
