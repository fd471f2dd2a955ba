"""The skew-safe ordered helpers equal plain windows, also with one hot group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.plans.ordered import lag_in_group, prefix_sum, row_index_in_group


def _data(spark):
    # group 0 holds most rows (a hot key); order ties broken by id.
    return spark.range(0, 3000).select(
        F.when(F.col("id") % 10 < 8, F.lit(0)).otherwise(F.col("id") % 7).alias("g"),
        (F.col("id") % 97).alias("t"), F.col("id"), (F.col("id") % 5 + 1).alias("w"))


def test_prefix_sum_matches_window(spark):
    df = _data(spark)
    got = {r["id"]: r["cb"] for r in prefix_sum(df, ["g"], ["t", "id"], "w", out="cb", parts=6)
           .select("id", "cb").collect()}
    w = Window.partitionBy("g").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = {r["id"]: r["cb"] for r in df.select("id", F.coalesce(F.sum("w").over(w), F.lit(0))
                                                  .alias("cb")).collect()}
    assert got == want


def test_lag_matches_window(spark):
    df = _data(spark)
    got = {r["id"]: r["prev_id"] for r in lag_in_group(df, ["g"], ["t", "id"], ["id"], parts=6)
           .select("id", "prev_id").collect()}
    w = Window.partitionBy("g").orderBy("t", "id")
    want = {r["id"]: r["p"] for r in df.select("id", F.lag("id").over(w).alias("p")).collect()}
    assert got == want


def test_row_index_matches_row_number(spark):
    df = _data(spark)
    got = {r["id"]: r["rn"] for r in row_index_in_group(df, ["g"], ["t", "id"], parts=5)
           .select("id", "rn").collect()}
    w = Window.partitionBy("g").orderBy("t", "id")
    want = {r["id"]: r["rn"] for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
    assert got == want


def test_hot_group_is_spread_over_slices(spark):
    from quarry.plans.ordered import SLICE, range_slices
    df = _data(spark)  # one group holds 80% of the rows
    sizes = [r["n"] for r in range_slices(df, ["g"], ["t", "id"], parts=6)
             .groupBy(SLICE).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 5
    assert max(sizes) < 3000 * 0.8 / 2  # the hot group is not in one task
