"""Operators against brute force on small inputs (random and the sf0.001 tables)."""

import hashlib
import random

import pandas as pd

from quarry.operators import profile as P
from quarry.plans.q_io import _stream_src
from quarry.streaming import incremental as ST

SF = "/root/testdata/sf0.001"


def test_duplicate_rows_random(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", None]), rng.choice([0.5, None]))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    want = int(pd.DataFrame(rows).duplicated().sum())
    assert P.duplicate_rows(df).collect()[0][0] == want


def test_top_values_vs_pandas(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    pdf = o.toPandas()
    got = {(r["column"], r["rank"]): (r["value"], r["n"]) for r in P.top_values(o, k=3).collect()}
    for col in ["o_orderstatus", "o_orderpriority"]:
        vc = pdf[col].value_counts()
        ranked = sorted(vc.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
        for i, (v, n) in enumerate(ranked, start=1):
            assert got[(col, i)] == (v, n)


def test_quantiles_vs_pandas(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_partkey")
    prof = {r["column"]: r for r in P.profile_table(li).collect()}
    pdf = li.toPandas()
    for c in pdf.columns:
        s = pdf[c].astype(float)
        assert prof[c]["median"] == round(float(s.quantile(0.5)), 6)
        assert prof[c]["q1"] == round(float(s.quantile(0.25)), 6)
        assert prof[c]["q3"] == round(float(s.quantile(0.75)), 6)
        assert prof[c]["unique_count"] == s.nunique()


def test_stream_dedup_stores_each_content_once(spark):
    got = ST.stream_dedup(_stream_src(spark, SF, "documents"), "text")
    texts = spark.read.parquet(f"{SF}/documents.parquet").toPandas()["text"]
    want = {hashlib.sha256(t.encode()).hexdigest() for t in texts}
    rows = got.collect()
    assert len(rows) == len(want) and {r["blob_hash"] for r in rows} == want


def test_audit_stream_appends_every_event(spark):
    got = ST.audit_stream(_stream_src(spark, SF, "events"))
    assert got.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_stream_dedup_skips_registered_contents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = docs.toPandas()["text"]
    stored = sorted({hashlib.sha256(t.encode()).hexdigest() for t in texts})[:5]
    registry = spark.createDataFrame([(h,) for h in stored], "blob_hash string")
    got = ST.stream_dedup(_stream_src(spark, SF, "documents"), "text", registry=registry)
    want = {hashlib.sha256(t.encode()).hexdigest() for t in texts} - set(stored)
    assert {r["blob_hash"] for r in got.collect()} == want
