"""Version comparison, schema sets, metric merge, text reports, previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.numeric import exact_mean_sql as M
from quarry.functions.numeric import round_sql as R
from quarry.operators import documents as D
from quarry.operators import lineage as L
from quarry.operators import profile as P
from quarry.operators import summary as S
from quarry.plans.catalog import Catalog, with_catalog
from quarry.plans.q_profile import EVENTS, LINEITEM, ORDERS
from quarry.plans.sql_profile import Col, profile_sql, top_values_sql
from quarry.plans.stored import EXTERNAL_METRICS, YEAR_A, YEAR_B, events_scored, stored_document, version
from quarry.sources.readers import preview_rows
from quarry.sources.tables import table

DOC_A, DOC_B = f"orders_{YEAR_A}.parquet", f"orders_{YEAR_B}.parquet"


def q_compare_commits(spark, sf):
    # from the stored documents of both versions, not from their rows
    a, b = stored_document(spark, sf, DOC_A), stored_document(spark, sf, DOC_B)
    return L.compare_profiles(D.long_profile(a), D.long_profile(b))


def _set(name):
    def q(spark, sf):
        pa = P.column_presence(version(spark, sf, YEAR_A, drop=("o_orderpriority",)))
        # version B lost the status column
        pb = P.column_presence(version(spark, sf, YEAR_B, drop=("o_orderstatus",)))
        return L.schema_sets(pa, pb)[name]
    return q


def q_merge_metrics(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", F.col("value").alias("score"), (F.col("value") / 100).alias("val_loss"))
    detected = P.custom_metrics(ev, order_by="event_id").withColumn("position", F.lit(0))
    return D.merge_metrics(detected, EXTERNAL_METRICS).drop("position")


def q_rule_summary(spark, sf):
    li = S.rule_summary(table(spark, sf, "lineitem"), "lineitem.parquet", "parquet")
    ev = S.rule_summary(events_scored(spark, sf), "events.parquet", "parquet", order_by="event_id",
                        external_metrics=EXTERNAL_METRICS)
    return li.unionByName(ev)


def q_profile_context(spark, sf):
    return S.profile_context(table(spark, sf, "orders"), "orders.parquet", "parquet")


def q_stats_preview(spark, sf):
    return S.stats_preview(table(spark, sf, "orders"))


def q_preview_rows(spark, sf):
    return preview_rows(table(spark, sf, "orders"), ["o_orderkey"], 100)


def q_read_version(spark, sf):
    cat = Catalog(spark, sf)
    heads = L.branch_heads(cat.commits).select(F.col("head_id").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(heads, "l_orderkey", "left_semi")


QUERIES = {
    "compare_commits": q_compare_commits,
    "schema_union": _set("union"),
    "schema_common": _set("common"),
    "schema_added": _set("added"),
    "schema_removed": _set("removed"),
    "merge_metrics": q_merge_metrics,
    "rule_summary": q_rule_summary,
    "profile_context": q_profile_context,
    "stats_preview": q_stats_preview,
    "preview_rows": q_preview_rows,
    "read_version": q_read_version,
}

# ---------------------------------------------------------------------------
# oracles
# ---------------------------------------------------------------------------

_A_COLS = [c for c in ORDERS if c.name != "o_orderpriority"]
_A_SRC = (f"(SELECT {', '.join(c.name for c in _A_COLS)} FROM orders "
          f"WHERE year(o_orderdate) = {YEAR_A})")
_B_SRC = f"(SELECT * FROM orders WHERE year(o_orderdate) = {YEAR_B})"
_PA = profile_sql("orders", _A_COLS, source=_A_SRC)
_PB = profile_sql("orders", ORDERS, source=_B_SRC)


def _diff(m):
    return f"{R(f'CAST(b.{m} AS DOUBLE) - CAST(a.{m} AS DOUBLE)', 4)} AS {m}"


_COMPARE = f"""
WITH a AS ({_PA}), b AS ({_PB})
SELECT coalesce(a."column", b."column") AS "column",
       NOT coalesce(a.dtype = b.dtype, FALSE) AS dtype_changed,
       coalesce((SELECT max(row_count) FROM b), 0) - coalesce((SELECT max(row_count) FROM a), 0)
         AS row_count_diff,
       {', '.join(_diff(m) for m in L.COMPARE_METRICS)}
FROM a FULL OUTER JOIN b ON a."column" = b."column\""""

_SETS = {
    "union": 'SELECT "column" FROM a UNION SELECT "column" FROM b',
    "common": 'SELECT "column" FROM a INTERSECT SELECT "column" FROM b',
    "added": 'SELECT "column" FROM b EXCEPT SELECT "column" FROM a',
    "removed": 'SELECT "column" FROM a EXCEPT SELECT "column" FROM b',
}


def summary_sql(source: str, file_name: str, cols: list[Col], metric_cols=(), external=None):
    prof = profile_sql(file_name, cols, source=source)
    tv = top_values_sql(source, cols, k=1)
    ordinals = " ".join(f"WHEN '{c.name}' THEN {i}" for i, c in enumerate(cols))
    metric_txt = "''"
    if metric_cols or external:
        det = " UNION ALL ".join(
            f"SELECT '{m}' AS metric, {i} AS dpos, ' Recorded ''{m}'' peak: ' || "
            f"CAST({R(f'(SELECT max({m}) FROM {source})', 6)} AS VARCHAR) || '.' AS dt"
            for i, m in metric_cols) or "SELECT NULL AS metric, NULL AS dpos, NULL AS dt WHERE FALSE"
        ext = "SELECT NULL AS metric, NULL AS epos, NULL AS et WHERE FALSE"
        if external:
            ext = (f"SELECT k AS metric, row_number() OVER () - 1 AS epos, "
                   f"' ' || upper(k[1]) || lower(k[2:]) || ': ' || "
                   f"json_extract_string('{external}', '$.\"' || k || '\"') || '.' AS et "
                   f"FROM (SELECT unnest(json_keys('{external}')) AS k)")
        metric_txt = (f"coalesce((SELECT string_agg(coalesce(e.et, d.dt), '' ORDER BY "
                      f"coalesce(d.dpos, 1048576 + e.epos)) FROM ({det}) d FULL OUTER JOIN ({ext}) e "
                      f"ON d.metric = e.metric), '')")
    return f"""
WITH prof AS ({prof}),
tv AS (SELECT t."column", t.value, CASE t."column" {ordinals} END AS ordinal FROM ({tv}) t),
num AS (SELECT "column", mean, min, max FROM prof WHERE mean IS NOT NULL ORDER BY ordinal LIMIT 1),
cat AS (SELECT "column", value FROM tv ORDER BY ordinal LIMIT 1),
hn AS (SELECT string_agg(t, ', ' ORDER BY ordinal) AS t FROM (
         SELECT ordinal, "column" || ' (' || CAST(null_pct AS VARCHAR) || '%)' AS t FROM prof
         WHERE null_pct > 5 ORDER BY ordinal LIMIT 2))
SELECT '{file_name}' AS file_name, trim(
  format('{{:,}}', (SELECT max(row_count) FROM prof)) || ' rows, {len(cols)} cols. {file_name} (PARQUET) focus.'
  || coalesce((SELECT ' Notably, ''' || "column" || ''' averages ' || printf('%.2f', {R('mean', 2)})
       || ' (range: ' || CAST(min AS VARCHAR) || ' to ' || CAST(max AS VARCHAR) || ').' FROM num), '')
  || coalesce((SELECT ' The most frequent ''' || "column" || ''' is ''' || value || '''.' FROM cat), '')
  || coalesce((SELECT ' Quality issues: High nulls in ' || t || '.' FROM hn WHERE t IS NOT NULL),
              ' Data quality appears robust with minimal nulls.')
  || {metric_txt}) AS summary"""


_EV_SCORED = ("(SELECT event_id, ts, user_id, event_type, value AS score, props FROM events)")
_EV_COLS = [Col(c.name if c.name != "value" else "score", c.kind, c.dtype) for c in EVENTS]

_PREVIEW_PROF = profile_sql("orders", ORDERS)


def _fmt6(c):
    return f"coalesce(printf('%.6f', {c}), 'n/a')"


_TOPTXT = f"""SELECT "column", string_agg(value || ':' || CAST(n AS VARCHAR), ', ' ORDER BY rank) AS top_values
FROM ({top_values_sql('orders', ORDERS, k=5)}) GROUP BY "column\""""

_PREVIEW = f"""
WITH prof AS ({_PREVIEW_PROF}), tops AS ({_TOPTXT})
SELECT p."column", p.ordinal, p.dtype, p.mean, p.std, p.min, p.max, p.null_pct, t.top_values,
       p.null_pct > 0 AS null_alert
FROM prof p LEFT JOIN tops t ON p."column" = t."column" WHERE p.ordinal < 5"""

_CONTEXT = f"""
WITH prev AS ({_PREVIEW}), prof AS ({_PREVIEW_PROF})
SELECT 'orders.parquet' AS file_name,
  'Dataset: orders.parquet (PARQUET)' || chr(10) || 'Rows: ' || CAST((SELECT max(row_count) FROM prof) AS VARCHAR)
  || ', Columns: ' || CAST((SELECT count(*) FROM prof) AS VARCHAR) || chr(10) || 'Statistics:' || chr(10)
  || (SELECT string_agg('- ' || "column" || ' (' || dtype || '): mean=' || {_fmt6('mean')}
        || ', std=' || {_fmt6('std')} || ', min=' || {_fmt6('min')} || ', max=' || {_fmt6('max')}
        || ', null_pct=' || {_fmt6('null_pct')}
        || CASE WHEN top_values IS NOT NULL THEN ', top=' || top_values ELSE '' END, chr(10) ORDER BY ordinal)
      FROM prev) AS context"""

_MERGE = f"""
WITH detected AS (
  SELECT 'score' AS metric, {R('arg_max(value, event_id) FILTER (WHERE value IS NOT NULL)', 6)} AS latest,
         {R('max(value)', 6)} AS max, {M('value')} AS mean FROM events
  UNION ALL
  SELECT 'val_loss', {R('arg_max(value / 100, event_id) FILTER (WHERE value IS NOT NULL)', 6)},
         {R('max(value / 100)', 6)}, {M('value / 100')} FROM events),
ext AS (SELECT k AS metric, json_extract_string('{EXTERNAL_METRICS}', '$."' || k || '"') AS ext_value
        FROM (SELECT unnest(json_keys('{EXTERNAL_METRICS}')) AS k))
SELECT coalesce(d.metric, e.metric) AS metric,
       CASE WHEN e.ext_value IS NOT NULL THEN 'external' ELSE 'detected' END AS source,
       CASE WHEN e.ext_value IS NOT NULL THEN NULL ELSE d.latest END AS latest,
       CASE WHEN e.ext_value IS NOT NULL THEN NULL ELSE d.max END AS max,
       CASE WHEN e.ext_value IS NOT NULL THEN NULL ELSE d.mean END AS mean,
       e.ext_value AS value
FROM detected d FULL OUTER JOIN ext e ON d.metric = e.metric"""

ORACLE = {
    "compare_commits": _COMPARE,
    **{f"schema_{k}": f"WITH a AS ({_PA}), b AS (SELECT * FROM ({_PB}) WHERE \"column\" <> 'o_orderstatus') {v}" for k, v in _SETS.items()},
    "merge_metrics": _MERGE,
    "rule_summary": ("SELECT * FROM (" + summary_sql("lineitem", "lineitem.parquet", LINEITEM)
                     + ")\nUNION ALL\nSELECT * FROM ("
                     + summary_sql(_EV_SCORED, "events.parquet", _EV_COLS,
                                         metric_cols=((4, "score"),), external=EXTERNAL_METRICS)
                     + ")"),
    "profile_context": _CONTEXT,
    "stats_preview": _PREVIEW,
    "preview_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100",
    "read_version": with_catalog("""
SELECT l.* FROM lineitem l WHERE l_orderkey IN (
  SELECT arg_max(id, (created_at, id)) FROM commits GROUP BY project_id, branch)""", "commits"),
}
