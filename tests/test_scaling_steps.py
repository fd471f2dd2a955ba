"""Steps that must not grow with the data on the driver, in one task or in one shuffle."""

import hashlib
import os

import numpy as np

from quarry.functions.metricql import metric_value, metrics_map
from quarry.operators import cas
from quarry.operators import metric_index as M
from quarry.operators import profile as P
from quarry.plans import q_catalog, q_sketches
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hash_files_makes_no_folder_per_file_and_asks_no_status_per_file(spark, tmp_folder, monkeypatch):
    names = [(i, f"name {i}") for i in range(60)] + [(60, None), (61, "two"), (61, "lines")]
    spark.createDataFrame(names, "s_suppkey long, s_name string").coalesce(1).write.parquet(f"{tmp_folder}/supplier.parquet")
    folders = []
    monkeypatch.setattr(q_catalog, "scratch_dir", lambda spark, name: folders.append(f"{tmp_folder}/{name}") or folders[0])
    monkeypatch.setattr(cas, "_empty_files", lambda *a: 1 / 0)
    got = {r["file_key"]: (r["blob_hash"], r["size_bytes"]) for r in q_catalog.q_hash_files(spark, tmp_folder).collect()}
    want = {i: f"name {i}\n" for i in range(60)} | {60: "\n", 61: "two\nlines\n"}
    assert got == {k: (hashlib.sha256(t.encode()).hexdigest(), len(t)) for k, t in want.items()}
    assert len(os.listdir(folders[0])) <= 4


def test_hash_files_finds_empty_files_in_tasks(spark, tmp_folder, monkeypatch):
    monkeypatch.setattr(cas, "_empty_files", lambda *a: 1 / 0)
    os.makedirs(f"{tmp_folder}/a/b")
    for name in ("none", "a/none", "a/b/none", "a/b/.hidden", "a/_left"):
        open(f"{tmp_folder}/{name}", "wb").close()
    with open(f"{tmp_folder}/a/one", "wb") as f:
        f.write(b"1")
    got = [r["path"].rsplit(tmp_folder, 1)[1] for r in cas.hash_files(spark, tmp_folder).collect()]
    assert sorted(got) == ["/a/b/none", "/a/none", "/a/one", "/none"]


def test_further_quantiles_by_distributed_ranks(spark, tmp_folder):
    rng = np.random.default_rng(5)
    x = rng.normal(size=500).round(2)
    df = spark.createDataFrame([(float(v), int(v * 10), None) for v in x], "x double, y long, t string")
    marks = [("a", 0.0), ("b", 0.24), ("c", 0.51), ("d", 1.0)]
    prof, found = P.profile_with_quantiles(df, marks)
    got = {r["column"]: [r[n] for n, _ in marks] for r in found.collect()}
    for name, v in (("x", x), ("y", [int(k * 10) for k in x])):
        assert np.allclose(got[name], np.quantile(v, [q for _, q in marks]))
    assert set(got) == {"x", "y"} and prof.count() == 3
    assert "percentile" not in _plan(q_sketches.q_sketch_profile(spark, "/root/testdata/sf0.001"))


def test_duplicate_rows_moves_no_row_without_a_candidate(spark):
    df = spark.range(2000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t"))
    out = P.duplicate_rows(df.unionByName(df.where("id < 3")).unionByName(df.where("id = 1")))
    assert out.first()[0] == 4
    plan = _plan(P.duplicate_rows(df))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_metric_columns_read_each_metric_once(spark):
    names = [f"m{i}" for i in range(12)]
    rows = [(1, '{"custom_metrics":{"m0":1,"m1":{"latest":2.5},"m2":"x","m3":true,"m4":null,"m5":{"max":3},"m6":"4d"}}'), (2, "{}"), (3, None), (4, "no json")]
    records = spark.createDataFrame(rows, "id long, stats string")
    out = M.with_metric_columns(records, names)
    assert _plan(out).count("from_json") <= 6
    m = F.coalesce(metrics_map(F.col("stats")), F.create_map().cast("map<string,string>"))
    want = records.select("id", *[F.when(F.map_contains_key(m, n), metric_value(m, n)).alias(M.value_column(n)) for n in names])
    assert out.select(*want.columns).sort("id").collect() == want.sort("id").collect()
    first = out.where("id = 1").first()
    assert [n for n in names if first[M.mark_column(n)]] == ["m2", "m4", "m6"]


def test_duplicates_of_a_state_by_whole_hashes(spark):
    from quarry.streaming import incremental as ST
    when = F.timestamp_seconds(F.lit(0)).alias("modified")
    cells = [("f", -1, 7, "a", 1), ("f", -1, 7, "b", 1), ("f", -1, 8, "a", 2), ("f", -1, 8, "a", 1), ("f", 0, 7, "a", 5), ("g", -1, 8, "a", 1), ("g", -1, 9, "c", 1)]
    state = (spark.createDataFrame(cells, "file_path string, cidx int, l long, s string, cnt long")
             .select("file_path", when, "cidx", "l", F.lit(None).cast("double").alias("d"), "s", "cnt"))
    assert {r["file_path"]: r["duplicate_rows"] for r in ST._duplicates(state).collect()} == {"f": 2}
    assert "BroadcastHashJoin" in _plan(ST._duplicates(state))


def test_reference_counts_aggregate_the_lines_once(spark, tmp_folder, monkeypatch):
    from datetime import datetime

    from quarry.plans import q_history
    from quarry.plans.catalog import Catalog
    early, late = datetime(1994, 1, 1), datetime(1998, 1, 1)
    lines = [(1, 1, 1, early), (2, 1, 2, late), (3, 1, 3, None), (4, 1, 4, late), (4, 1, 5, early), (5, 1, 6, early), (5, 2, 6, late)]
    (spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp_ntz")
     .select("*", F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus")).write.parquet(f"{tmp_folder}/lineitem.parquet"))
    spark.createDataFrame([(k, k) for k in range(1, 8)], "p_partkey long, p_size int").write.parquet(f"{tmp_folder}/part.parquet")
    spark.createDataFrame([(1, "abc")], "doc_id long, text string").write.parquet(f"{tmp_folder}/documents.parquet")
    for name in ("tree_entries", "shipped_entries"):
        monkeypatch.setattr(Catalog, name, property(lambda self: 1 / 0))
    got = sorted(r["size_bytes"] for r in q_history.q_gc_reference_counts(spark, tmp_folder).collect())
    assert got == [3, 200000, 300000, 400000, 700000]  # parts 1, 5 and 6 are held by shipped lines


def test_hashes_are_counted_whatever_their_form(spark):
    from quarry.operators import history as H
    digest = hashlib.sha256(b"x").hexdigest()
    rows = [digest, digest, digest.upper(), "h4", "h4", "", None]
    got = {r["blob_hash"]: r["n"] for r in H._count_by_hash(spark.createDataFrame([(r,) for r in rows], "object_hash string"), "n").collect()}
    assert got == {digest: 2, digest.upper(): 1, "h4": 2, "": 1, None: 1}
