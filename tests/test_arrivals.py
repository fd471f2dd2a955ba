"""File hashes in chunks, and the blob registry kept as a table over several streaming runs."""

import hashlib
import os

from quarry.operators.cas import hash_files
from quarry.streaming import incremental as ST


def test_hash_files_in_chunks(spark, tmp_folder):
    contents = {"a.bin": b"abc" * 50000, "deep/er/b c.txt": "h\u00e9llo".encode() * 999, "deep/=x.csv": b"x", "none": b""}
    for name, data in contents.items():
        path = os.path.join(tmp_folder, "files", name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    want = {name: (hashlib.sha256(data).hexdigest(), len(data)) for name, data in contents.items()}
    for path in (f"{tmp_folder}/files", f"file:{tmp_folder}/files"):
        for chunk in (7, 1 << 20):
            rows = hash_files(spark, path, chunk).collect()
            assert {r["path"].split("/files/", 1)[1]: (r["blob_hash"], r["size_bytes"]) for r in rows} == want


def test_registry_over_growing_folders(spark, tmp_folder):
    incoming, registry = f"{tmp_folder}/in", f"{tmp_folder}/registry"

    def run(*texts):
        if texts:
            spark.createDataFrame([(t,) for t in texts], "text string").write.mode("append").parquet(incoming)
        stream = ST.file_stream(spark, incoming, "*.parquet", spark.createDataFrame([], "text string").schema)
        return sorted(r["blob_hash"] for r in ST.dedup_into_registry(stream, "text", registry).collect())

    def hashes(*texts):
        return sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert run("a", "b", "a", None, "") == hashes("a", "b", "")
    assert run("b", "c", "c") == hashes("c")
    assert run() == []
    assert run("a", "b", "c", "") == []
    assert run("d") == hashes("d")
    assert spark.read.parquet(f"{registry}/blobs").count() == 5
