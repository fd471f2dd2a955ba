"""Sketch profiles: merged versions equal the whole, errors stay in their bounds, edge columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.operators import sketches as S


@pytest.fixture(scope="module")
def df(spark):
    base = spark.range(0, 60000, 1, 6)
    x = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    return base.select(F.col("id"), (x % 20000).cast("int").alias("many"), F.when(x % 5 > 0, x / 7.0).alias("real"), (x % 2 == 0).alias("flag"),
                       F.concat(F.lit("v"), (x % 300).cast("string")).alias("text"), F.lit(None).cast("double").alias("none"),
                       F.lit(4.5).alias("same"), (x / 100).cast("decimal(20,2)").alias("money"), (x % 7).alias("version"))


def test_merged_versions_equal_the_whole_within_bounds(spark, df):
    rows = S.sketch_rows(df, ["version"])
    merged = {r["column"]: r for r in S.profile_of_sketches(S.merge_sketches(rows)).collect()}
    exact = {r["column"]: r for r in P.profile_table(df.drop("version")).collect()}
    assert set(merged) == set(exact)
    pdf = df.toPandas()
    for name, want in exact.items():
        got = merged[name]
        for c in ("ordinal", "dtype", "row_count", "null_count", "null_pct", "mean", "min", "max"):
            assert got[c] == want[c], (name, c)
        for c in ("std", "skewness", "kurtosis"):
            assert got[c] == want[c] or got[c] == pytest.approx(want[c], rel=1e-6, abs=1e-4), (name, c)
        assert abs(got["unique_count"] - want["unique_count"]) <= 0.04 * want["unique_count"]
        if want["median"] is not None:
            values = np.sort(pdf[name].dropna().astype(float).to_numpy())
            for c, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
                low, high = (np.searchsorted(values, got[c], side) / len(values) for side in ("left", "right"))
                assert low - 0.01 <= q <= high + 0.01


def test_versions_merge_stepwise(spark, df):
    rows = S.sketch_rows(df.select("many", "text", "version"), ["version"])
    halves = S.merge_sketches(rows.withColumn("half", F.col("version") % 2), ["half"])
    one, two = (S.profile_of_sketches(S.merge_sketches(r)).drop("unique_count", "median", "q1", "q3").collect() for r in (halves.drop("half"), rows))
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_sketch_option_of_the_profile(spark, df):
    got = {(r["version"], r["column"]): r for r in P.profile_by_group(df, ["version"], exact=False).collect()}
    want = {(r["version"], r["column"]): r for r in P.profile_by_group(df, ["version"]).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k]["mean"] == w["mean"] and got[k]["row_count"] == w["row_count"]
        assert abs(got[k]["unique_count"] - w["unique_count"]) <= max(1, 0.04 * w["unique_count"])
        if k[1] in ("flag", "text"):
            assert got[k]["mode"] == w["mode"]
    empty = P.profile_table(df.limit(0), exact=False).collect()
    assert all(r["row_count"] == 0 and r["unique_count"] == 0 and r["mean"] is None for r in empty) and len(empty) == 9
