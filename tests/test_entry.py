"""Driver contract and the compare / state operators on the catalog."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.operators import lineage as L
from quarry.operators import profile as P


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 11


def test_every_query_has_an_oracle_or_a_brute_force_test():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    own = {k for k in q if not re.match(r"op\d+_", k) and k != "pipeline"}
    assert own == own & set(o)


def test_compare_one_sided_column(spark):
    a = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    b = spark.createDataFrame([(1.0, 3.0), (2.0, 4.0), (5.0, 1.0)], "x double, z double")
    rows = {r["column"]: r for r in L.compare_profiles(P.profile_table(a), P.profile_table(b)).collect()}
    assert rows["z"]["dtype_changed"] is True and rows["z"]["mean"] is None
    assert rows["x"]["dtype_changed"] is False and rows["x"]["row_count_diff"] == 1


def test_diff_with_itself_is_zero(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    p = P.profile_table(o)
    d = L.compare_profiles(p, p).collect()
    assert all(not r["dtype_changed"] and r["row_count_diff"] == 0 for r in d)
    assert all(r[m] in (0.0, None) for r in d for m in L.COMPARE_METRICS)


def test_state_at_takes_latest_entry(spark):
    commits = spark.createDataFrame(
        [(1, 1, "main", 1), (2, 1, "main", 2), (3, 1, "main", 9)],
        "id long, project_id int, branch string, tree_id long").withColumn(
        "created_at", F.make_timestamp_ntz(F.lit(2020), F.lit(1), F.col("id").cast("int"),
                                           F.lit(0), F.lit(0), F.lit(0)))
    entries = spark.createDataFrame([(1, "f.csv", "h1"), (2, "f.csv", "h2"), (9, "f.csv", "h9")],
                                    "tree_id long, name string, object_hash string")
    got = L.state_at(commits, entries, "2020-01-02T12:00:00").collect()
    assert [(r["name"], r["object_hash"]) for r in got] == [("f.csv", "h2")]


def test_nested_log_gathers_records_per_commit(spark):
    from quarry.plans.catalog import Catalog
    cat = Catalog(spark, "/root/testdata/sf0.001")
    flat = L.project_log(cat.commits, cat.users, cat.metadata, cat.projects, project="NATION_1")
    nested = L.project_log(cat.commits, cat.users, cat.metadata, cat.projects, project="NATION_1",
                           nested=True)
    rows = nested.collect()
    assert len(rows) == flat.select("commit_id").distinct().count()
    assert sum(len(r["metadata"]) for r in rows) == flat.where(F.col("metadata_id").isNotNull()).count()
    ts = [r["created_at"] for r in rows]
    assert ts == sorted(ts, reverse=True)


def test_content_hash_of_several_columns(spark):
    from quarry.operators.cas import content_hash
    df = spark.createDataFrame([(1, None), (None, 1)], "a int, b int")
    hs = [r["content_hash"] for r in content_hash(df, ["a", "b"]).collect()]
    assert len(set(hs)) == 2


def test_pointer_jumping_ranks_and_ancestry(spark):
    import random
    rng = random.Random(3)
    parent = {}
    nid = 0
    for _ in range(4):  # four linear chains of random length, one very long
        prev = None
        for _ in range(rng.randint(1, 40) if _ else 300):
            parent[nid] = prev
            prev, nid = nid, nid + 1
    edges = spark.createDataFrame(list(parent.items()), "id long, parent_id long")
    got = {r["id"]: (r["root_id"], r["depth"]) for r in L.rank_by_pointers(edges).collect()}

    def walk(v):
        d = 0
        while parent[v] is not None:
            v, d = parent[v], d + 1
        return v, d
    assert got == {v: walk(v) for v in parent}
    heads = [v for v in parent if v not in set(parent.values())]
    of = spark.createDataFrame([(h,) for h in heads], "id long")
    anc = {(r["start_id"], r["ancestor_id"], r["depth"])
           for r in L.ancestry_by_pointers(edges, of).collect()}
    want = set()
    for h in heads:
        v, d = parent[h], 1
        while v is not None:
            want.add((h, v, d))
            v, d = parent[v], d + 1
    assert anc == want


def test_cluster_without_shared_folder_raises():
    import pytest

    from quarry.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
