"""Version catalog tables derived from the driver's test tables.

The reference keeps users, projects, commits, trees, blobs, metadata records
and an audit log in a database.  Here each is a DataFrame Spark derives from
the TPC-H-like tables, by rules that DuckDB can apply identically (the SQL
twins below), so every catalog query grows with the data:

=============  ==================  =============================================
table          from                rule
=============  ==================  =============================================
users          customer            id = c_custkey, username = c_name
projects       nation              id = n_nationkey, name = n_name,
                                   owner_id = n_nationkey
commits        orders, customer    id = o_orderkey, project = c_nationkey,
                                   author = o_custkey, branch = o_orderpriority,
                                   message = 'order <key>', created_at =
                                   o_orderdate, tree_id = o_orderkey
tree_entries   lineitem            one per (l_orderkey, l_linenumber):
                                   id = orderkey*10 + linenumber, object =
                                   sha256('part:' || min(l_partkey))
blobs          part, documents     part content sha256('part:' || p_partkey),
                                   size p_size*100000; document texts
                                   sha256(text), size = UTF-8 bytes (distinct)
metadata       orders, lineitem,   one record per order with lines (stats JSON
               events              with file name/type, line count, metrics);
                                   one per event (target -(event_id+1): not
                                   a commit; metrics = props JSON)
audit_log      events              user_id, upper(event_type), props, ts
pull_requests  orders, customer    one per order; status from o_orderstatus
=============  ==================  =============================================
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import table

PART_PREFIX = "part:"
PART_SIZE_UNIT = 100000
SHIPPED_BEFORE = "1995-06-01"


def _file_type_of_status(c):
    return (F.when(c == "F", F.lit("csv")).when(c == "O", F.lit("json"))
             .otherwise(F.lit("parquet")))


@dataclass
class Catalog:
    spark: SparkSession
    sf_dir: str

    def _t(self, name):
        return table(self.spark, self.sf_dir, name)

    @property
    def users(self) -> DataFrame:
        c = self._t("customer")
        return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"),
                        F.concat(F.lower(F.regexp_replace("c_name", "#", "_")),
                                 F.lit("@example.org")).alias("email"),
                        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("admin"))
                         .otherwise(F.lit("user")).alias("role"))

    @property
    def projects(self) -> DataFrame:
        n = self._t("nation")
        return n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
                        F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))
                         .alias("description"),
                        F.col("n_nationkey").cast("long").alias("owner_id"))

    @property
    def commits(self) -> DataFrame:
        o = self._t("orders")
        c = self._t("customer").select("c_custkey", "c_nationkey")
        return (o.join(c, o.o_custkey == c.c_custkey, "inner")
                 .select(F.col("o_orderkey").alias("id"),
                         F.col("c_nationkey").alias("project_id"),
                         F.col("o_custkey").alias("author_id"),
                         F.col("o_orderpriority").alias("branch"),
                         F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("message"),
                         F.col("o_orderdate").alias("created_at"),
                         F.col("o_orderkey").alias("tree_id")))

    @property
    def tree_entries(self) -> DataFrame:
        return self._entries(self._t("lineitem"))

    @property
    def shipped_entries(self) -> DataFrame:
        """The entries of lines shipped before ``SHIPPED_BEFORE``: the ones still referenced when blobs are collected."""
        return self._entries(self._t("lineitem").where(self._shipped()))

    @staticmethod
    def _shipped() -> Column:
        return F.col("l_shipdate") < F.lit(SHIPPED_BEFORE).cast("timestamp_ntz")

    @property
    def entry_parts(self) -> DataFrame:
        """(id, pk, now, kept): the part of every entry among all lines, and among the shipped ones if it is ``kept`` there;
        ``tree_entries`` and ``shipped_entries`` side by side, from one aggregate."""
        shipped = F.coalesce(self._shipped(), F.lit(False))
        return (self._t("lineitem").groupBy("l_orderkey", "l_linenumber")
                .agg(F.min("l_partkey").alias("pk"), F.min(F.when(shipped, F.col("l_partkey"))).alias("now"), F.bool_or(shipped).alias("kept"))
                .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "pk", "now", "kept"))

    @staticmethod
    def part_hash(pk: str) -> Column:
        return F.sha2(F.concat(F.lit(PART_PREFIX), F.col(pk).cast("string")), 256)

    @staticmethod
    def _entries(li: DataFrame) -> DataFrame:
        ext = (F.when(F.min("l_returnflag") == "A", F.lit(".csv"))
                .when(F.min("l_returnflag") == "R", F.lit(".json"))
                .when(F.min("l_linestatus") == "O", F.lit(".parquet"))
                .otherwise(F.lit(".txt")))
        g = li.groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_partkey").alias("pk"), ext.alias("ext"))
        return g.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("tree_id"),
            F.concat(F.lit("line_"), F.col("l_linenumber").cast("string"), F.col("ext")).alias("name"),
            F.lit("file").alias("mode"),
            Catalog.part_hash("pk").alias("object_hash"))

    @property
    def blobs(self) -> DataFrame:
        p = self._t("part").select(
            self.part_hash("p_partkey").alias("blob_hash"),
            (F.col("p_size").cast("long") * PART_SIZE_UNIT).alias("size_bytes"),
            F.lit("part").alias("origin"))
        d = (self._t("documents")
             .select(F.sha2(F.col("text"), 256).alias("blob_hash"),
                     F.octet_length("text").cast("long").alias("size_bytes"))
             .groupBy("blob_hash").agg(F.min("size_bytes").alias("size_bytes"))
             .withColumn("origin", F.lit("document")))
        return p.unionByName(d)

    @property
    def metadata(self) -> DataFrame:
        o = self._t("orders")
        lines = (self._t("lineitem").groupBy("l_orderkey")
                 .agg(F.count(F.lit(1)).alias("n_lines"), F.min("l_discount").alias("min_disc"),
                      F.max("l_tax").alias("max_tax")))
        ftype = _file_type_of_status(F.col("o_orderstatus"))
        acc = F.col("o_totalprice") / 500000
        metrics = F.struct(
            F.struct(acc.alias("latest"), (acc + F.col("max_tax")).alias("max"),
                     (acc / 2).alias("mean")).alias("accuracy"),
            F.col("min_disc").alias("loss"),
            F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("xgb")).alias("model"))
        stats = F.to_json(F.struct(
            F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit("."), ftype).alias("file_name"),
            ftype.alias("file_type"),
            F.col("n_lines").alias("row_count"),
            F.lit(11).alias("column_count"),
            metrics.alias("custom_metrics")))
        om = (o.join(lines, o.o_orderkey == lines.l_orderkey, "inner")
               .select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("target_id"),
                       stats.alias("stats"),
                       (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("indexed_at")))
        ev = self._t("events")
        ev_stats = F.concat(
            F.lit('{"file_name":"event_'), F.col("event_id").cast("string"),
            F.lit('.json","file_type":"json","row_count":'), F.col("user_id").cast("string"),
            F.lit(',"column_count":6,"custom_metrics":'), F.col("props"), F.lit("}"))
        em = ev.select((F.lit(1000000000000) + F.col("event_id")).alias("id"),
                       (-(F.col("event_id") + 1)).alias("target_id"),
                       ev_stats.alias("stats"), F.col("ts").alias("indexed_at"))
        return om.unionByName(em)

    @property
    def audit_log(self) -> DataFrame:
        ev = self._t("events")
        return ev.select(F.col("event_id").alias("id"), F.col("user_id"),
                         F.upper("event_type").alias("action"),
                         F.lit("events").alias("table_name"),
                         F.col("event_id").cast("string").alias("record_id"),
                         F.col("props").alias("details"),
                         F.col("ts").alias("performed_at"))

    @property
    def pull_requests(self) -> DataFrame:
        o = self._t("orders")
        c = self._t("customer").select("c_custkey", "c_nationkey")
        status = (F.when(F.col("o_orderstatus") == "O", F.lit("open"))
                   .when(F.col("o_orderstatus") == "F", F.lit("merged"))
                   .otherwise(F.lit("closed")))
        return (o.join(c, o.o_custkey == c.c_custkey, "inner")
                 .select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("project_id"),
                         F.concat(F.lit("merge order "), F.col("o_orderkey").cast("string")).alias("title"),
                         F.col("o_orderpriority").alias("source_branch"),
                         F.lit("main").alias("target_branch"), status.alias("status"),
                         F.col("o_custkey").alias("author_id"),
                         F.col("o_orderdate").alias("created_at")))


# ---------------------------------------------------------------------------
# DuckDB twins (CTE bodies)
# ---------------------------------------------------------------------------

def _entries_sql(where: str = "") -> str:
    return f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS tree_id,
        'line_' || CAST(l_linenumber AS VARCHAR) ||
        CASE WHEN min(l_returnflag) = 'A' THEN '.csv' WHEN min(l_returnflag) = 'R' THEN '.json'
             WHEN min(l_linestatus) = 'O' THEN '.parquet' ELSE '.txt' END AS name,
        'file' AS mode, sha256('{PART_PREFIX}' || CAST(min(l_partkey) AS VARCHAR)) AS object_hash
        FROM lineitem {where} GROUP BY l_orderkey, l_linenumber"""


CATALOG_SQL = {
    "users": """SELECT c_custkey AS id, c_name AS username,
        lower(replace(c_name, '#', '_')) || '@example.org' AS email,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'user' END AS role FROM customer""",
    "projects": """SELECT n_nationkey AS id, n_name AS name,
        'region ' || CAST(n_regionkey AS VARCHAR) AS description,
        CAST(n_nationkey AS BIGINT) AS owner_id FROM nation""",
    "commits": """SELECT o_orderkey AS id, c_nationkey AS project_id, o_custkey AS author_id,
        o_orderpriority AS branch, 'order ' || CAST(o_orderkey AS VARCHAR) AS message,
        o_orderdate AS created_at, o_orderkey AS tree_id
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "tree_entries": _entries_sql(),
    "shipped_entries": _entries_sql(f"WHERE l_shipdate < TIMESTAMP '{SHIPPED_BEFORE}'"),
    "blobs": f"""SELECT sha256('{PART_PREFIX}' || CAST(p_partkey AS VARCHAR)) AS blob_hash,
        CAST(p_size AS BIGINT) * {PART_SIZE_UNIT} AS size_bytes, 'part' AS origin FROM part
        UNION ALL
        SELECT sha256(text) AS blob_hash, min(CAST(strlen(text) AS BIGINT)) AS size_bytes,
               'document' AS origin FROM documents GROUP BY sha256(text)""",
    "metadata": """SELECT o_orderkey AS id, o_orderkey AS target_id,
        CAST(json_object(
          'file_name', 'order_' || CAST(o_orderkey AS VARCHAR) || '.' ||
              CASE o_orderstatus WHEN 'F' THEN 'csv' WHEN 'O' THEN 'json' ELSE 'parquet' END,
          'file_type', CASE o_orderstatus WHEN 'F' THEN 'csv' WHEN 'O' THEN 'json' ELSE 'parquet' END,
          'row_count', n_lines, 'column_count', 11,
          'custom_metrics', json_object(
              'accuracy', json_object('latest', o_totalprice / 500000,
                                      'max', o_totalprice / 500000 + max_tax,
                                      'mean', o_totalprice / 500000 / 2),
              'loss', min_disc,
              'model', CASE WHEN o_orderpriority = '1-URGENT' THEN 'xgb' END)) AS VARCHAR) AS stats,
        o_orderdate + INTERVAL 1 DAY AS indexed_at
        FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines, min(l_discount) AS min_disc,
                                 max(l_tax) AS max_tax FROM lineitem GROUP BY l_orderkey) li
          ON o_orderkey = li.l_orderkey
        UNION ALL
        SELECT 1000000000000 + event_id, -(event_id + 1),
        '{"file_name":"event_' || CAST(event_id AS VARCHAR) || '.json","file_type":"json","row_count":'
          || CAST(user_id AS VARCHAR) || ',"column_count":6,"custom_metrics":' || props || '}',
        ts FROM events""",
    "audit_log": """SELECT event_id AS id, user_id, upper(event_type) AS action, 'events' AS table_name,
        CAST(event_id AS VARCHAR) AS record_id, props AS details, ts AS performed_at FROM events""",
    "pull_requests": """SELECT o_orderkey AS id, c_nationkey AS project_id,
        'merge order ' || CAST(o_orderkey AS VARCHAR) AS title, o_orderpriority AS source_branch,
        'main' AS target_branch,
        CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'merged' ELSE 'closed' END AS status,
        o_custkey AS author_id, o_orderdate AS created_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
}


def with_catalog(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs of the named catalog tables."""
    ctes = ",\n".join(f"{n} AS ({CATALOG_SQL[n]})" for n in names)
    return f"WITH {ctes}\n{sql}"
