"""Profile-family queries on the test tables and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.numeric import exact_mean_sql as M
from quarry.functions.numeric import round_sql as R
from quarry.operators import profile as P
from quarry.plans.sql_profile import (Col, histogram_sql, mode_sql, profile_sql,
                                      top_values_sql)
from quarry.sources.tables import table

LINEITEM = [
    Col("l_orderkey", "integral", "bigint"), Col("l_partkey", "integral", "bigint"),
    Col("l_suppkey", "integral", "bigint"), Col("l_linenumber", "integral", "int"),
    Col("l_quantity", "fractional", "double"), Col("l_extendedprice", "fractional", "double"),
    Col("l_discount", "fractional", "double"), Col("l_tax", "fractional", "double"),
    Col("l_returnflag", "string", "string"), Col("l_linestatus", "string", "string"),
    Col("l_shipdate", "other", "timestamp_ntz"),
]
ORDERS = [
    Col("o_orderkey", "integral", "bigint"), Col("o_custkey", "integral", "bigint"),
    Col("o_orderstatus", "string", "string"), Col("o_totalprice", "fractional", "double"),
    Col("o_orderdate", "other", "timestamp_ntz"), Col("o_orderpriority", "string", "string"),
]
EVENTS = [
    Col("event_id", "integral", "bigint"), Col("ts", "other", "timestamp_ntz"),
    Col("user_id", "integral", "bigint"), Col("event_type", "string", "string"),
    Col("value", "fractional", "double"), Col("props", "string", "string"),
]
# lineitem grouped by return flag: numeric and categorical columns.
LINE_GROUPED = [c for c in LINEITEM if c.name not in ("l_returnflag",)]


def q_profile_table(spark, sf):
    return P.profile_table(table(spark, sf, "lineitem"))


def q_profile_by_group(spark, sf):
    return P.profile_by_group(table(spark, sf, "lineitem"), ["l_returnflag"])


def q_top_values(spark, sf):
    return P.top_values(table(spark, sf, "orders"), k=5)


def q_mode(spark, sf):
    return P.mode(table(spark, sf, "events"))


def q_histogram(spark, sf):
    return P.histogram(table(spark, sf, "lineitem"))


def q_duplicate_rows(spark, sf):
    # Whole rows; the large orders' lines come a second time.
    li = table(spark, sf, "lineitem")
    return P.duplicate_rows(li.unionAll(li.where("l_quantity > 45")))


def q_custom_metrics(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", F.col("value").alias("score"),
        (F.col("value") / 100).alias("val_loss"), F.col("event_type"))
    return P.custom_metrics(ev, order_by="event_id")


def q_latest_metric(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", F.col("value").alias("score"))
    return (P.custom_metrics(ev.drop("user_id"), order_by="event_id")
            .select("metric", "latest"))


def q_high_null_columns(spark, sf):
    li = table(spark, sf, "lineitem")
    # Missing values made from the data itself: zero discount / zero tax are
    # treated as unknown, which is what a NULLIF projection in the SQL does.
    li = (li.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
            .withColumn("l_tax", F.nullif("l_tax", F.lit(0.0))))
    return P.high_null_columns(P.null_ratios(li))


def q_metric_column_select(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", F.col("value").alias("score"), (F.col("value") > 50).alias("is_f1_flag"),
        F.col("event_type").alias("loss_kind"), F.col("user_id").alias("auc_bucket"))
    names = P.metric_columns(ev)
    return ev.select(*names).agg(*[F.count(c).alias(c) for c in names]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in names])))


def q_top_k_per_column(spark, sf):
    return P.top_values(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus"), k=2)


QUERIES = {
    "profile_table": q_profile_table,
    "profile_by_group": q_profile_by_group,
    "top_values": q_top_values,
    "mode": q_mode,
    "histogram": q_histogram,
    "duplicate_rows": q_duplicate_rows,
    "custom_metrics": q_custom_metrics,
    "latest_metric": q_latest_metric,
    "high_null_columns": q_high_null_columns,
    "metric_column_select": q_metric_column_select,
    "top_k_per_column": q_top_k_per_column,
}

_HIGH_NULL_SRC = ("(SELECT nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax, "
                  "l_quantity FROM lineitem)")

ORACLE = {
    "profile_table": profile_sql("lineitem", LINEITEM),
    "profile_by_group": profile_sql("lineitem", LINE_GROUPED, keys=["l_returnflag"]),
    "top_values": top_values_sql("orders", ORDERS),
    "mode": mode_sql("events", EVENTS),
    "histogram": histogram_sql("lineitem", LINEITEM),
    "duplicate_rows": ("WITH r AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_quantity > 45) "
                       "SELECT CAST((SELECT count(*) FROM r) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS BIGINT) "
                       "AS duplicate_rows"),
    "custom_metrics": f"""
SELECT metric, {R('latest', 6)} AS latest, {R('mx', 6)} AS max, mn AS mean FROM (
  SELECT 'score' AS metric, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS latest,
         max(value) AS mx, {M('value')} AS mn FROM events
  UNION ALL
  SELECT 'val_loss', arg_max(value / 100, event_id) FILTER (WHERE value IS NOT NULL),
         max(value / 100), {M('value / 100')} FROM events)""",
    "latest_metric": f"""
SELECT 'score' AS metric, {R('arg_max(value, event_id) FILTER (WHERE value IS NOT NULL)', 6)} AS latest
FROM events""",
    "high_null_columns": f"""
SELECT "column", null_count, null_pct FROM (
  SELECT 'l_discount' AS "column", count(*) - count(l_discount) AS null_count,
         {R('(count(*) - count(l_discount)) / count(*) * 100', 2)} AS null_pct FROM {_HIGH_NULL_SRC}
  UNION ALL
  SELECT 'l_tax', count(*) - count(l_tax), {R('(count(*) - count(l_tax)) / count(*) * 100', 2)}
  FROM {_HIGH_NULL_SRC}
  UNION ALL
  SELECT 'l_quantity', count(*) - count(l_quantity),
         {R('(count(*) - count(l_quantity)) / count(*) * 100', 2)} FROM {_HIGH_NULL_SRC})
WHERE null_pct > 5""",
    "metric_column_select": """
SELECT "column", n FROM (
  SELECT 'score' AS "column", count(value) AS n FROM events
  UNION ALL SELECT 'is_f1_flag', count(value > 50) FROM events
  UNION ALL SELECT 'auc_bucket', count(user_id) FROM events)""",
    "top_k_per_column": top_values_sql(
        "lineitem", [c for c in LINEITEM if c.name in ("l_returnflag", "l_linestatus")], k=2),
}
