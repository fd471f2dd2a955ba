"""Property tests: the profile equals pandas/NumPy on random columns."""

import math

import numpy as np
from pyspark.sql import functions as F
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.operators import profile as P

floats = st.one_of(st.none(), st.just(float("nan")),
                   st.integers(-50, 50).map(lambda i: i / 4.0))
ints = st.one_of(st.none(), st.integers(-1000, 1000))
words = st.one_of(st.none(), st.sampled_from(["a", "b", "c", "dd"]))


def _close(a, b, tol=1.5e-6):
    if a is None or b is None or (isinstance(b, float) and math.isnan(b)):
        return a is None and (b is None or math.isnan(b))
    return abs(a - b) <= tol * max(1.0, abs(b))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(floats, ints, words), min_size=1, max_size=40))
def test_profile_matches_pandas(spark, rows):
    df = spark.createDataFrame(rows, "x double, i long, w string")
    prof = {r["column"]: r for r in P.profile_table(df).collect()}
    pdf = pd.DataFrame(rows, columns=["x", "i", "w"]).astype({"x": "float64"})
    for col in ["x", "i", "w"]:
        s = pdf[col]
        p = prof[col]
        assert p["row_count"] == len(s)
        assert p["null_count"] == int(s.isna().sum())
        assert p["unique_count"] == int(s.nunique())
        if col == "w":
            vc = s.value_counts()
            if len(vc):
                best = sorted(vc.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
                assert p["mode"] == best
            continue
        clean = s.dropna().astype(float)
        if len(clean) == 0:
            assert p["mean"] is None and p["median"] is None
            continue
        assert _close(p["mean"], float(clean.mean()))
        assert _close(p["min"], float(clean.min())) and _close(p["max"], float(clean.max()))
        for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert _close(p[name], float(np.quantile(clean, q)))
        std = float(clean.std()) if len(clean) > 1 else None
        assert (p["std"] is None) if std is None else _close(p["std"], std)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-20, 20)), min_size=2, max_size=60))
def test_histogram_matches_numpy(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    clean = np.array([v for v in vals if v is not None], dtype=float)
    got = [r["n"] for r in P.histogram(df).orderBy("bin").collect()]
    if len(clean) < 2:
        assert got == []
    else:
        counts, _ = np.histogram(clean, bins=10)
        assert got == counts.tolist()


def test_grouped_profile_with_null_group_key(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 2.0), ("a", 4.0), ("a", 6.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in P.profile_by_group(df, ["g"]).collect()}
    assert got[None]["median"] == 2.0 and got[None]["mean"] == 2.0 and got[None]["std"] == 1.414214
    assert got["a"]["median"] == 4.0 and got["a"]["row_count"] == 3


def test_means_of_large_totals_use_one_rule(spark):
    # totals of 1e11 and 2e19 units above what a long of 1e-9 units holds
    df = spark.range(40).select((F.lit(5e9) + F.col("id") * 0.01).alias("x"), (F.lit(1e14) + F.col("id") * 10000 * 0.5).alias("y"),
                                (F.lit(9 * 10 ** 17) + F.col("id")).alias("z"))
    got = {r["column"]: r["mean"] for r in P.profile_table(df).collect()}
    assert got == {"x": 5000000000.195, "y": 1e14 + 97500.0, "z": float(9 * 10 ** 17 + 19.5)}
    from quarry.functions.numeric import exact_mean
    assert df.agg(exact_mean(F.col("x"))).first()[0] == 5000000000.195


def test_profile_document_histogram_matches_numpy(spark):
    import json

    from quarry.operators.documents import profile_document
    vals = [0.5, 1.25, 1.25, 2.0, 3.75, 7.0, None, 9.5, 10.0]
    df = spark.createDataFrame([(v, "a" if v and v > 2 else "b") for v in vals], "x double, s string")
    doc = json.loads(profile_document(df, "t.csv", "csv").collect()[0]["stats"])
    dist = {d["column"]: d for d in doc["distributions"]}
    clean = np.array([v for v in vals if v is not None])
    counts, edges = np.histogram(clean, bins=10)
    assert dist["x"]["counts"] == counts.tolist()
    assert dist["x"]["bin_edges"] == [round(e, 4) for e in edges.tolist()]
    assert doc["row_count"] == len(vals) and doc["column_count"] == 2
    assert doc["columns_schema"] == {"x": "double", "s": "string"}
    assert doc["summary"].startswith("9 rows, 2 cols. t.csv (CSV) focus.")


def test_group_keys_may_share_internal_names(spark):
    rows = [("a", 1, 1.0), ("a", 1, 3.0), ("b", 2, 5.0)]
    df = spark.createDataFrame(rows, "s string, cnt int, x double")
    got = {(r["s"], r["cnt"]): r for r in P.profile_by_group(df, ["s", "cnt"]).collect()}
    assert got[("a", 1)]["median"] == 2.0 and got[("b", 2)]["row_count"] == 1
    assert P.histogram(df, keys=["s", "cnt"]).columns[:2] == ["s", "cnt"]
    assert P.top_values(df.select("s", "cnt"), keys=["cnt"]).count() == 2


def test_float_text_is_python_text(spark):
    from quarry.functions.text import float_text
    vals = [0.0, 1.0, -2.5, 29000000.0, 4e-4, 1e-5, -1.25e-7, 1e16, 9.5e15, 1.5e300, 123456789.125]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double").select(float_text(F.col("x"))).collect()]
    assert got == [str(v) for v in vals]
