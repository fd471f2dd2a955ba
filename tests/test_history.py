"""Forked ancestry, state at a commit and reference counts against plain Python."""

import random

import pytest

from quarry.operators import history as H
from quarry.operators import lineage as L


@pytest.fixture(scope="module")
def parents():
    rng = random.Random(8)
    out = {0: None}
    for i in range(1, 300):
        out[i] = i - 1 if rng.random() < 0.8 else rng.randrange(i) if rng.random() < 0.9 else None
    out[300] = 999  # a parent that nobody knows
    return out


def walk(parents, start):
    at, depth = start, 0
    while at in parents:
        yield at, depth
        at, depth = parents[at], depth + 1


def test_ancestors_of_a_forest_with_forks(spark, parents):
    lifting = H.lifting_table(spark.createDataFrame(list(parents.items()), "id long, parent_id long"))
    starts = [0, 5, 77, 150, 299, 300]
    of = spark.createDataFrame([(s,) for s in [*starts, 299]], "id long")
    want = {(s, a, d) for s in starts for a, d in walk(parents, s)}
    assert {tuple(r) for r in H.ancestors(lifting, of, itself=True).collect()} == want
    got = H.ancestors(lifting, of).collect()
    assert len(got) == len(want) - len(starts) and {tuple(r) for r in got} == {w for w in want if w[2]}


def test_state_at_commits(spark, parents):
    rng = random.Random(4)
    entries = [(i, f"f{rng.randrange(12)}", f"h{i}-{k}") for i in parents for k in range(2)]
    entries = list({(t, n): (t, n, h) for t, n, h in entries}.values())
    commits = spark.createDataFrame([(i, i) for i in parents], "id long, tree_id long")
    lifting = H.lifting_table(spark.createDataFrame(list(parents.items()), "id long, parent_id long"))
    starts = [3, 120, 299]
    got = H.state_at_commits(lifting, commits, spark.createDataFrame(entries, "tree_id long, name string, object_hash string"),
                             spark.createDataFrame([(s,) for s in starts], "id long")).collect()
    want = set()
    for s in starts:
        seen = {}
        for at, _ in walk(parents, s):
            for t, name, h in entries:
                if t == at:
                    seen.setdefault(name, (h, at))
        want |= {(s, name, *v) for name, v in seen.items()}
    assert {tuple(r) for r in got} == want


def test_roots_only_and_unreadable_time(spark):
    lifting = H.lifting_table(spark.createDataFrame([(1, None), (2, None)], "id long, parent_id long"))
    assert lifting.count() == 0 and H.ancestors(lifting, spark.createDataFrame([(1,)], "id long")).count() == 0
    with pytest.raises(ValueError, match="yesterday"):
        L.state_at(None, None, "yesterday")


def test_forked_parents(spark):
    commits = spark.createDataFrame([(1, 1, "a", 1), (2, 1, "a", 2), (3, 1, "b", 2), (4, 1, "b", 9), (5, 1, "c", 0), (6, 2, "b", 5)],
                                    "id long, project_id int, branch string, t int").selectExpr(
        "id", "project_id", "branch", "timestamp_ntz '2020-01-01' + make_interval(0, 0, 0, t) as created_at")
    assert {r["id"]: r["parent_id"] for r in H.forked_parents(commits).collect()} == {1: None, 2: 1, 3: 2, 4: 3, 5: None, 6: None}


def test_reference_counts(spark):
    blobs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "blob_hash string, size_bytes long")

    def entries(*hashes):
        return spark.createDataFrame([(h,) for h in hashes], "object_hash string")
    counts = H.reference_counts(blobs, entries("a", "a", "b"))
    assert {r["blob_hash"]: r["refs"] for r in counts.collect()} == {"a": 2, "b": 1, "c": 0}
    after = H.update_counts(counts, added=entries("c", "d"), removed=entries("b", "a"),
                            new_blobs=spark.createDataFrame([("d", 7), ("a", 1)], "blob_hash string, size_bytes long"))
    assert {r["blob_hash"]: (r["size_bytes"], r["refs"]) for r in after.collect()} == {"a": (1, 1), "b": (2, 0), "c": (3, 1), "d": (7, 1)}
    assert [r["blob_hash"] for r in H.unreferenced(after).collect()] == ["b"]
