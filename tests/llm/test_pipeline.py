"""The corpus pipeline: every stage with clashing columns, nulls, repeated rows and empty tables; MinHash groups under the threshold."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

CLASHES = ["_text", "_email", "_ip", "_card", "_phone", "_candidate", "_secret", "_items", "_score", "row", "r", "key", "sig", "band", "rep", "score", "kept", "set"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    path = str(tmp_path_factory.mktemp("tables"))
    item = words(rng, 40)
    rows = [(i, words(rng, 60) + (" vilebadword" if i % 5 == 4 else "")) for i in range(200)]
    rows += [(300, rows[0][1] + " tail"), (301, words(rng, 20) + " " + item + " " + words(rng, 20)), (302, "write to someone@example.org or 10.1.2.3 now " + words(rng, 8)),
             (303, None), (304, ""), (305, "x " * 30000), (None, words(rng, 30)), (None, None), rows[1], (2, "another text under a known id " + words(rng, 30))]
    spark.createDataFrame([(i, t, "xx", "s", len(t or ""), *["mine"] * len(CLASHES)) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 4)) for i in range(200)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "q")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_columns_and_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        rows = out.collect()
        assert all(r[c] == "mine" for r in rows for c in CLASHES), name
        texts = {(r["doc_id"], r["text"]) for r in rows}
        gone = {r["doc_id"] for r in docs.collect()} - {i for i, _ in texts}
        if name == "toxicity":
            assert gone == {i for i in range(200) if i % 5 == 4}
        elif name == "minhash_near_dedup":
            assert gone == {300} and len(rows) == before - 2 and sum(r["doc_id"] == 2 for r in rows) == 2
        elif name == "benchmark_decontamination":
            assert gone == {301} and len(rows) == before - 1
        else:
            text = dict(texts)[302]
            assert not gone and len(rows) == before and "<EMAIL>" in text and "<IP>" in text and "example.org" not in text
            assert next(r["n_chars"] for r in rows if r["doc_id"] == 302) == len(text)
    assert pipeline.STAGES[-1][1](spark, docs, folder).count() == before


def test_run(spark, folder):
    got = pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in got}
    assert ids == {None, *(i for i in range(200) if i % 5 != 4), 302, 303, 304, 305} and len(got) == 160 + 4 + 2 + 1


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    # without labels nothing is rejected below a score of one half, without a benchmark nothing is contaminated
    assert pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == docs.count()
    bare = docs.select("doc_id", "text")
    assert pipeline.redact_personal_data(spark, bare, folder).columns == ["doc_id", "text"]


def test_minhash_groups_just_under_the_threshold(spark, monkeypatch):
    """Many members that pass the signature screen and are no links, in several blocks of a bucket."""
    from quarry.llm import minhash

    rng = random.Random(9)
    base = words(rng, 60).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 1, 1, 0, 2])):
            w[rng.randrange(60)] = f"edit{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k: k + 3]) for k in range(58)} for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = 0
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            links += 1
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {(i, find(i)) for i in sets}
    for block in (512, 16):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
        assert {(r["doc_id"], r["component_id"]) for r in got} == want
    assert 10 < links < 11175


def test_across_returns_a_forest(spark):
    """All members of a bucket similar and in components of their own: one link less than members."""
    import numpy as np
    import pyarrow as pa

    from quarry.llm import minhash

    n = 200
    one = np.arange(50, dtype=np.uint64)
    sig = np.zeros(minhash.BANDS * minhash.ROWS, np.uint16).tobytes()
    side = [0] * n + [1] * n
    table = pa.table({"side": pa.array(side, pa.int32()), "small": pa.array([1] * 2 * n, pa.int32()), "nth": pa.array([0] * 2 * n, pa.int32()),
                      "rep": pa.array([*range(n)] * 2, pa.int64()), "comp": pa.array([*range(n)] * 2, pa.int64()),
                      "sig": pa.array([sig] * 2 * n, pa.binary()), "set": pa.array([one.tobytes()] * 2 * n, pa.binary())})
    out = minhash._across(0.85, 85)([None, pa.scalar(0), pa.scalar(0)], table)
    assert out.num_rows == n - 1


def test_hash_tables_stay_small():
    """The two stages that hash words keep a few MB of tables in a worker, whatever the size of a batch."""
    import numpy as np
    import pyarrow as pa

    from quarry.llm import common, minhash, toxicity
    rng = np.random.default_rng(3)
    texts = ["".join(chr(97 + x) if x < 26 else " " for x in rng.integers(0, 30, 4000)) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array(texts)], ["doc_id", "text"])
    minhash.HASH.bytes_powers = common.Powers(int(minhash.HASH.bytes_powers.base))
    assert sum(b.num_rows for b in minhash._describe(5)([batch])) == 1200
    assert toxicity.SMALL_PIECE == common.SMALL_PIECE
    assert minhash.HASH.bytes_powers.up.nbytes + minhash.HASH.bytes_powers.down.nbytes < 16 << 20


def test_estimates_of_components_stay_small(spark, capsys):
    """Spark's estimate of the size of the edges does not multiply from round to round."""
    from quarry.llm.components import connected_components

    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    out = connected_components(chain)
    assert {(r["node"], r["component"]) for r in out.collect()} == {(i, 0) for i in range(61)}
    capsys.readouterr()
    out.explain(mode="cost")
    powers = [int(x) for x in re.findall(r"sizeInBytes=[0-9.]+E\+([0-9]+)", capsys.readouterr().out)]
    assert max([0, *powers]) < 60


def test_small_steps_have_few_tasks(spark, monkeypatch):
    """However many partitions the shuffle has, the tables of the steps after the signatures have as many as the texts ask for."""
    from quarry.llm import components, minhash

    rng = random.Random(5)
    base = words(rng, 60).split()
    rows = [(i, " ".join(base[: i % 60] + [f"edit{i}"] + base[i % 60 + 1:])) for i in range(40)]
    made = []

    def kept(df, cut=minhash.cut):
        out = cut(df)
        made.append(out.rdd.getNumPartitions())
        return out
    monkeypatch.setattr(minhash, "cut", kept)
    monkeypatch.setattr(components, "cut", kept)
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 40 and {r["component_id"] for r in got} == {0}
    assert len(made) > 10 and max(made) <= max(2 * spark.sparkContext.defaultParallelism, 16)
