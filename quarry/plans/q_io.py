"""Readers, sinks and streaming queries.

Sink and streaming keys write to a fresh folder under the shared scratch
area (``spark.checkpoint.dir``), read back what they wrote and return it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.clean import NA_TOKENS
from quarry.operators import documents as D
from quarry.operators import lineage as L
from quarry.plans.catalog import Catalog, with_catalog
from quarry.plans.q_profile import EVENTS, LINEITEM
from quarry.plans.q_reports import summary_sql
from quarry.plans.sql_profile import histogram_sql, profile_sql, top_values_sql
from quarry.plans.stored import EXTERNAL_METRICS, stored_document
from quarry.sources import readers as R
from quarry.sources import sinks as K
from quarry.sources.tables import table
from quarry.streaming import incremental as ST

ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
EVENT_COLS = "event_id, user_id, event_type, value, props"


def q_scan_parquet(spark, sf):
    li = R.scan_parquet(spark, f"{sf.rstrip('/')}/lineitem.parquet")
    return (li.where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
              .select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))


def q_load_dataset(spark, sf):
    return R.load_dataset(spark, f"{sf.rstrip('/')}/orders.parquet", "pq")


def q_scan_csv(spark, sf):
    out = K.new_location(spark, "orders-csv")
    table(spark, sf, "orders").write.option("header", True).csv(out)
    return R.scan_csv(spark, out, times=True)


def q_scan_csv_quoted(spark, sf):
    # whole texts: commas, doubled quotes, line ends inside fields, missing-value tokens
    out = K.new_location(spark, "documents-csv")
    (table(spark, sf, "documents").withColumn("code", F.concat(F.col("n_chars").cast("string"), F.lit("d")))
        .write.option("header", True).option("quoteAll", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out))
    return R.scan_csv(spark, out, multiline=True)


def q_scan_json(spark, sf):
    out = K.new_location(spark, "events-json")
    table(spark, sf, "events").write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(out)
    # times are text in JSON
    return R.load_dataset(spark, out, "json").select(*EVENT_COLS.split(", "), F.to_timestamp_ntz("ts").alias("ts"))


def q_index_append(spark, sf):
    doc = stored_document(spark, sf, "lineitem.parquet")
    whole = ["file_name", "file_type", "column_count", "duplicate_rows", "summary"]
    dtype = F.try_element_at("columns_schema", F.col("column"))
    return (D.long_profile(doc.select(*whole, "columns_schema", "statistics"), [*whole, "columns_schema"])
            .withColumn("schema_dtype", dtype).drop("columns_schema"))


def q_stored_top_values(spark, sf):
    return D.long_top_values(stored_document(spark, sf, "lineitem.parquet"))


def q_stored_histogram(spark, sf):
    return D.long_histogram(stored_document(spark, sf, "lineitem.parquet"))


def q_stored_metrics(spark, sf):
    return D.long_metrics(stored_document(spark, sf, "events.parquet"))


def q_stored_json(spark, sf):
    # the JSON form of the document holds the same statistics
    kind = "array<struct<column:string,row_count:bigint,unique_count:bigint,mode:string>>"
    doc = stored_document(spark, sf, "events.parquet")
    parsed = F.from_json("stats", f"struct<file_name:string,row_count:bigint,duplicate_rows:bigint,statistics:{kind}>")
    return doc.select(parsed.alias("d")).select("d.file_name", "d.duplicate_rows", F.inline("d.statistics"))


def q_audit_append(spark, sf):
    out = K.new_location(spark, "audit")
    K.audit_append(Catalog(spark, sf).audit_log, out)
    return spark.read.parquet(out).select("id", "user_id", "action", "record_id", "details",
                                          "performed_at")


def q_json_sink(spark, sf):
    out = K.new_location(spark, "heads-json")
    heads = L.branch_heads(Catalog(spark, sf).commits)
    K.json_sink(heads, out)
    return spark.read.schema(heads.schema).json(out)


def _stream_src(spark, sf, name):
    schema = table(spark, sf, name).schema
    return ST.file_stream(spark, sf, f"{name}.parquet", schema)


def q_incremental_profile(spark, sf):
    index = ST.incremental_profile(_stream_src(spark, sf, "lineitem"))
    return D.long_profile(index, ["file_name"])


def q_stream_dedup(spark, sf):
    return ST.stream_dedup(_stream_src(spark, sf, "documents"), "text")


def q_stream_dedup_registry(spark, sf):
    # the even documents arrive first; the second run stores only contents that are new with the odd ones
    docs, out = table(spark, sf, "documents").select("doc_id", "text"), K.new_location(spark, "blob-registry")
    for rest in (0, 1):
        docs.where(F.abs("doc_id") % 2 == rest).write.mode("append").parquet(f"{out}/incoming")
        new = ST.dedup_into_registry(ST.file_stream(spark, f"{out}/incoming", "*.parquet", docs.schema), "text", f"{out}/registry")
    return new


def q_audit_stream(spark, sf):
    return ST.audit_stream(_stream_src(spark, sf, "events")).select(
        "id", "user_id", "action", "record_id", "details", "performed_at")


QUERIES = {
    "scan_parquet": q_scan_parquet,
    "load_dataset": q_load_dataset,
    "scan_csv": q_scan_csv,
    "scan_csv_quoted": q_scan_csv_quoted,
    "scan_json": q_scan_json,
    "index_append": q_index_append,
    "stored_top_values": q_stored_top_values,
    "stored_histogram": q_stored_histogram,
    "stored_metrics": q_stored_metrics,
    "stored_json": q_stored_json,
    "audit_append": q_audit_append,
    "json_sink": q_json_sink,
    "incremental_profile": q_incremental_profile,
    "stream_dedup": q_stream_dedup,
    "stream_dedup_registry": q_stream_dedup_registry,
    "audit_stream": q_audit_stream,
}

_AUDIT = """SELECT id, user_id, action, record_id, details, performed_at FROM audit_log"""

ORACLE = {
    "scan_parquet": """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'""",
    "load_dataset": f"SELECT {ORDER_COLS} FROM orders",
    "scan_csv": f"SELECT {ORDER_COLS} FROM orders",
    "scan_csv_quoted": f"""
SELECT doc_id, CASE WHEN text IN ({", ".join(f"'{t}'" for t in NA_TOKENS)}) THEN NULL ELSE text END AS text,
       lang, source, n_chars, n_chars || 'd' AS code FROM documents""",
    "scan_json": f"SELECT {EVENT_COLS}, ts FROM events",
    "index_append": f"""
WITH prof AS ({profile_sql('lineitem', LINEITEM)}), said AS ({summary_sql('lineitem', 'lineitem.parquet', LINEITEM)})
SELECT 'lineitem.parquet' AS file_name, 'parquet' AS file_type, 11 AS column_count,
       (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows,
       (SELECT summary FROM said) AS summary, dtype AS schema_dtype, prof.* FROM prof""",
    "stored_top_values": top_values_sql("lineitem", LINEITEM),
    "stored_histogram": histogram_sql("lineitem", LINEITEM),
    "stored_metrics": f"""
SELECT 'score' AS metric, 'external' AS source, CAST(NULL AS DOUBLE) AS latest, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, '0.99' AS value
UNION ALL SELECT k, 'external', NULL, NULL, NULL, json_extract_string('{EXTERNAL_METRICS}', '$.' || k)
FROM (SELECT unnest(['optimizer', 'lr']) AS k)""",
    "stored_json": f"""
SELECT 'events.parquet' AS file_name, (SELECT count(*) FROM events) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events)) AS duplicate_rows,
       CASE "column" WHEN 'value' THEN 'score' ELSE "column" END AS "column", row_count, unique_count, mode FROM ({profile_sql('events', EVENTS)})""",
    "audit_append": with_catalog(_AUDIT, "audit_log"),
    "json_sink": with_catalog("""
SELECT project_id, branch, arg_max(id, (created_at, id)) AS head_id, count(*) AS commits
FROM commits GROUP BY project_id, branch""", "commits"),
    "incremental_profile": f"SELECT 'lineitem.parquet' AS file_name, * FROM ({profile_sql('lineitem', LINEITEM)})",
    "stream_dedup": "SELECT DISTINCT sha256(text) AS blob_hash, CAST(strlen(text) AS BIGINT) AS size_bytes "
                    "FROM documents",
    "stream_dedup_registry": """
SELECT DISTINCT sha256(text) AS blob_hash, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents
WHERE abs(doc_id) % 2 = 1 AND text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE abs(doc_id) % 2 = 0 AND text IS NOT NULL)""",
    "audit_stream": with_catalog(_AUDIT, "audit_log"),
}

