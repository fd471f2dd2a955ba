"""Hand-worked edge cases of the column profile (FIXTURES §3)."""

from pyspark.sql import functions as F

from quarry.operators import profile as P


def _prof(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return {r["column"]: r.asDict() for r in P.profile_table(df).collect()}


def test_moments_and_quantiles(spark):
    p = _prof(spark, [(1.0,), (2.0,), (3.0,), (4.0,)], "x double")["x"]
    assert p["mean"] == 2.5 and p["std"] == 1.290994
    assert (p["q1"], p["median"], p["q3"]) == (1.75, 2.5, 3.25)
    assert p["skewness"] == 0.0 and p["kurtosis"] == -1.36
    assert p["row_count"] == 4 and p["unique_count"] == 4 and p["null_count"] == 0


def test_constant_column(spark):
    p = _prof(spark, [(5.0,), (5.0,)], "x double")["x"]
    assert p["std"] == 0.0 and p["skewness"] is None and p["kurtosis"] is None
    h = P.histogram(spark.createDataFrame([(5.0,), (5.0,)], "x double")).orderBy("bin").collect()
    assert [r["n"] for r in h] == [0, 0, 0, 0, 0, 2, 0, 0, 0, 0]
    assert h[0]["lo"] == 4.5 and h[-1]["hi"] == 5.5


def test_one_row(spark):
    p = _prof(spark, [(7.0,)], "x double")["x"]
    assert p["std"] is None and p["mean"] == 7.0
    assert P.histogram(spark.createDataFrame([(7.0,)], "x double")).count() == 0


def test_all_null(spark):
    p = _prof(spark, [(None,), (None,)], "x double")["x"]
    assert p["null_count"] == 2 and p["null_pct"] == 100.0 and p["unique_count"] == 0
    assert p["mean"] is None and p["std"] is None and p["median"] is None


def test_nan_is_missing(spark):
    p = _prof(spark, [(float("nan"),), (1.0,), (None,)], "x double")["x"]
    assert p["null_count"] == 2 and p["unique_count"] == 1


def test_bool_top_values_and_histogram(spark):
    df = spark.createDataFrame([(True,), (False,), (True,)], "b boolean")
    tv = {r["value"]: r["n"] for r in P.top_values(df).collect()}
    assert tv == {"True": 2, "False": 1}
    h = P.histogram(df).orderBy("bin").collect()
    assert [r["n"] for r in h] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 2]
    assert _prof(spark, [(True,), (False,), (True,)], "b boolean")["b"]["mean"] is None


def test_top_value_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), ("c",)], "s string")
    tv = [(r["rank"], r["value"], r["n"]) for r in P.top_values(df).orderBy("rank").collect()]
    assert tv == [(1, "a", 2), (2, "b", 2), (3, "c", 1)]
    m = P.mode(df).collect()[0]
    assert m["mode"] == "a" and m["mode_count"] == 2


def test_duplicate_rows_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert P.duplicate_rows(df).collect()[0][0] == 1


def test_empty_table_has_a_row_per_column(spark):
    df = spark.createDataFrame([], "x double, s string")
    rows = P.profile_table(df).collect()
    assert sorted(r["column"] for r in rows) == ["s", "x"]
    assert all(r["row_count"] == 0 and r["null_pct"] is None for r in rows)


def test_histogram_counts_sum_to_non_null_rows(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    h = P.histogram(li).groupBy("column").agg(F.sum("n").alias("n")).collect()
    assert all(r["n"] == li.count() for r in h)


def test_profile_invariant_to_partitioning(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    a = sorted(tuple(r) for r in P.profile_table(li).collect())
    b = sorted(tuple(r) for r in P.profile_table(li.repartition(7)).collect())
    assert a == b


def test_exact_mean_on_ties(spark):
    # The exact mean 0.0000015 is a tie at the 6th digit: rounded half up on
    # the decimal value, whatever order the partial sums arrive in.
    df = spark.createDataFrame([(0.000001,), (0.000002,)], "x double").repartition(2)
    assert _prof(spark, [(0.000001,), (0.000002,)], "x double")["x"]["mean"] == 0.000002
    assert P.profile_table(df).collect()[0]["mean"] == 0.000002


def test_custom_metrics_latest_is_last_non_null(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, None)], "epoch int, accuracy double")
    m = P.custom_metrics(df, "epoch").collect()[0]
    assert (m["metric"], m["latest"], m["max"], m["mean"]) == ("accuracy", 0.7, 0.7, 0.6)


def test_metric_columns_need_numeric_type(spark):
    df = spark.createDataFrame([(1, "x", True)], "val_loss int, loss_name string, f1_ok boolean")
    assert P.metric_columns(df) == ["val_loss", "f1_ok"]


def test_text_only_and_bool_only_tables(spark):
    s = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "s string")
    p = P.profile_table(s).collect()[0]
    assert (p["unique_count"], p["null_count"], p["mode"], p["mean"]) == (2, 1, "x", None)
    b = spark.createDataFrame([(True,), (True,), (False,)], "b boolean")
    q = P.profile_table(b).collect()[0]
    assert (q["unique_count"], q["mode"], q["median"]) == (2, "True", None)
    g = spark.createDataFrame([("k", "x"), ("k", "y"), ("j", "x")], "g string, s string")
    rows = {r["g"]: r for r in P.profile_by_group(g, ["g"]).collect()}
    assert rows["k"]["unique_count"] == 2 and rows["j"]["row_count"] == 1


def test_nested_columns_profile_as_json_text(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    p = {r["column"]: r for r in P.profile_table(e).collect()}
    assert p["embedding"]["dtype"] == "array<float>"
    assert p["embedding"]["unique_count"] > 0 and p["embedding"]["mean"] is None


def test_duplicate_rows_with_maps(spark):
    df = spark.sql(
        "SELECT map('a', 1, 'b', 2) AS m, 1 AS i UNION ALL SELECT map('b', 2, 'a', 1), 1 UNION ALL SELECT NULL, 1 UNION ALL SELECT map('a', 1), 1")
    assert P.duplicate_rows(df).first()[0] == 1


def test_decimals_beyond_double_precision_stay_distinct(spark):
    df = spark.sql("SELECT CAST(x AS DECIMAL(38,2)) AS d FROM VALUES ('100000000000000000000.01'), ('100000000000000000000.02'), "
                   "('100000000000000000000.02'), (NULL) AS t(x)")
    r = P.profile_table(df).first()
    assert (r["unique_count"], r["null_count"], r["mode"]) == (2, 1, "100000000000000000000.02")
    assert P.high_null_columns(P.null_ratios(df)).first()["null_pct"] == 25.0
