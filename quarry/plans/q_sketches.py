"""Sketch profiles merged across versions, with their errors bounded against the exact statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.numeric import round_sql as R
from quarry.operators import profile as P
from quarry.operators import sketches as S
from quarry.plans.q_profile import LINEITEM
from quarry.plans.sql_profile import profile_sql
from quarry.sources.sinks import new_location
from quarry.sources.tables import table

DISTINCT_ERROR, RANK_ERROR = 0.05, 0.01
EXACT = ["column", "ordinal", "dtype", "row_count", "null_count", "null_pct", "mean", "min", "max"]


def q_sketch_profile(spark, sf):
    # one stored row per column and ship year; the whole table's profile is made from those rows
    li, out = table(spark, sf, "lineitem"), new_location(spark, "sketches")
    S.sketch_rows(li.withColumn("year", F.year("l_shipdate")), ["year"]).write.parquet(out)
    merged = S.profile_of_sketches(S.merge_sketches(spark.read.parquet(out)))
    bands = [(f"b{i}", q + d) for i, (q, d) in enumerate((q, d) for q in (0.25, 0.5, 0.75) for d in (-RANK_ERROR, RANK_ERROR))]
    profile, ranks = P.profile_with_quantiles(li, bands)
    exact = profile.select("column", F.col("unique_count").alias("distinct"))
    inside = [F.col(c).between(F.col(f"b{2 * i}"), F.col(f"b{2 * i + 1}")) for i, c in enumerate(("q1", "median", "q3"))]
    return (merged.join(exact, "column").join(ranks, "column", "left").select(
        *EXACT, F.round("std", 3).alias("std"), (F.abs(F.col("unique_count") - F.col("distinct")) <= DISTINCT_ERROR * F.col("distinct")).alias("distinct_ok"),
        (inside[0] & inside[1] & inside[2]).alias("ranks_ok")))


QUERIES = {"sketch_profile": q_sketch_profile}
ORACLE = {"sketch_profile": f"""
SELECT {', '.join(f'"{c}"' for c in EXACT)}, {R('std', 3)} AS std, TRUE AS distinct_ok, CASE WHEN mean IS NOT NULL THEN TRUE END AS ranks_ok
FROM ({profile_sql('lineitem', LINEITEM)})"""}
