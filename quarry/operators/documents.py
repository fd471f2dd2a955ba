"""Stored profile documents: one typed row per dataset version, and the way back to the long form.

A document holds everything that the profile of a version has: the statistics
of every column, top values, histograms, metrics (detected ones merged with
supplied ones), duplicate rows, schema and report text.  Its lists are as long
as the schema is wide.  Documents are appended to an index (Parquet,
partitioned by file type); listing, detail, comparison and reports read the
index and never the rows.  ``stats`` is the same document as JSON text.

Documents of many versions are made in one pass: every input of
:func:`assemble` carries the key columns of its version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.clean import kind_of
from quarry.functions.text import capitalize, float_text
from quarry.operators import profile as P
from quarry.operators.summary import summary_parts, summary_text

_PROFILE = ("ordinal int, column string, dtype string, row_count bigint, null_count bigint, null_pct double, unique_count bigint, mean double, std double, "
            "min double, max double, median double, q1 double, q3 double, skewness double, kurtosis double, mode string")
METRIC = "struct<metric:string,source:string,latest:double,max:double,mean:double,value:string>"
BODY = (f"row_count bigint, column_count int, duplicate_rows bigint, columns_schema map<string,string>, "
        f"statistics array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split() for x in _PROFILE.split(', ')))}>>, "
        "top_values array<struct<column: string, values: array<struct<rank: int, value: string, n: bigint>>>>, "
        "distributions array<struct<column: string, counts: array<bigint>, bin_edges: array<double>>>, "
        f"custom_metrics array<{METRIC}>, summary string, stats string")
INDEX_SCHEMA = f"file_name string, {BODY}, file_type string"


def merge_metrics(detected: DataFrame, supplied: str | None, keys: list[str] | None = None) -> DataFrame:
    """U4: (keys, metric, source, latest, max, mean, value, position): detected metrics
    ``(keys, metric, latest, max, mean, position)`` and those of a JSON object; a supplied one
    wins, keeps the position of the detected one it replaces, and has its JSON text in ``value``.

    With keys, each version that ``detected`` knows gets the supplied metrics
    (a parameter, so a few constants).
    """
    keys = list(keys or [])
    of = detected.select(*keys, "metric", "latest", "max", "mean", F.lit(None).cast("string").alias("value"),
                         F.lit("detected").alias("source"), F.col("position").cast("long").alias("position"))
    if supplied is None:
        return of
    entries = F.posexplode(F.map_entries(F.from_json(F.lit(supplied), "map<string,string>"))).alias("k", "e")
    versions = detected.select(*keys).distinct() if keys else detected.sparkSession.range(1).select()
    none = F.lit(None).cast("double")
    given = versions.select(*keys, entries).select(
        *keys, F.col("e.key").alias("metric"), none.alias("latest"), none.alias("max"), none.alias("mean"), F.col("e.value").alias("value"),
        F.lit("external").alias("source"), (F.lit(1 << 20) + F.col("k")).cast("long").alias("position"))
    whole = F.struct("source", "latest", "max", "mean", "value")
    return (of.unionByName(given).groupBy(*keys, "metric")
            .agg(F.max_by(whole, F.col("source") == "external").alias("m"), F.min("position").alias("position"))
            .select(*keys, "metric", "m.*", "position"))


def metric_sentence(m: Column) -> Column:
    """Report text of one merged metric: its peak, or a supplied scalar; other supplied values add nothing."""
    peak = F.get_json_object(m["value"], "$.max")
    shown = F.when(m["source"] == "detected", float_text(m["max"])).when(F.ltrim(m["value"]).startswith("{"), peak)
    scalar = F.when(~F.ltrim(m["value"]).startswith("{") & ~F.ltrim(m["value"]).startswith("["),
                    F.concat(F.lit(" "), capitalize(m["metric"]), F.lit(": "), m["value"], F.lit(".")))
    return F.coalesce(F.concat(F.lit(" Recorded '"), m["metric"], F.lit("' peak: "), shown, F.lit(".")), scalar, F.lit(""))


def assemble(schema: T.StructType, prof: DataFrame, hist: DataFrame, top: DataFrame, duplicates: DataFrame, metrics: DataFrame,
             keys: list[str], file_name: Column, file_type: str) -> DataFrame:
    """Documents ``(keys, file_name, file_type, ...)`` from long-form parts that all carry ``keys``.

    ``duplicates(keys, duplicate_rows)``; ``metrics`` as :func:`merge_metrics` returns them.
    """
    cats = [f.name for f in schema.fields if kind_of(f.dataType) in ("string", "bool")]
    position = F.create_map(*[x for i, f in enumerate(schema.fields) for x in (F.lit(f.name), F.lit(i))])

    def listed(df: DataFrame, order: Column, *fields) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*fields).alias("x")))), lambda e: e["x"])

    stats = prof.groupBy(*keys).agg(listed(prof, F.col("ordinal"), "ordinal", "column", *P.PROFILE_COLUMNS[2:]).alias("statistics"), *summary_parts(cats))
    bins = hist.groupBy(*keys, "column").agg(F.array_sort(F.collect_list(F.struct("bin", "lo", "hi", "n"))).alias("h"))
    dist = bins.groupBy(*keys).agg(listed(bins, position[F.col("column")], "column", F.transform("h", lambda e: e["n"]).alias("counts"), F.concat(
        F.transform("h", lambda e: e["lo"]), F.array(F.element_at("h", -1)["hi"])).alias("bin_edges")).alias("distributions"))
    ranked = top.groupBy(*keys, "column").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("values"))
    tops = ranked.groupBy(*keys).agg(listed(ranked, position[F.col("column")], "column", "values").alias("top_values"))
    merged = metrics.groupBy(*keys).agg(listed(metrics, F.col("position"), "metric", "source", "latest", "max", "mean", "value").alias("custom_metrics"))
    doc = stats
    for part in (dist, tops, duplicates, merged):
        doc = doc.join(part, keys, "left")
    types = {f.name: f.dataType for f in T._parse_datatype_string(BODY).fields}
    doc = doc.withColumns({c: F.coalesce(c, F.array().cast(types[c])) for c in ("top_values", "distributions", "custom_metrics")})
    said = F.array_join(F.transform("custom_metrics", metric_sentence), "")
    schema_map = F.create_map(*[x for f in schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    doc = doc.select(
        *keys, file_name.alias("file_name"), F.col("rows").alias("row_count"), F.lit(len(schema.fields)).alias("column_count"),
        F.coalesce("duplicate_rows", F.lit(0).cast("long")).alias("duplicate_rows"), schema_map.alias("columns_schema"), "statistics", "top_values",
        "distributions", "custom_metrics", summary_text(file_name, F.lit(file_type), len(schema.fields), said).alias("summary"),
        F.lit(file_type).alias("file_type"))
    body = [c for c in doc.columns if c not in keys or c == "file_name"]
    return doc.withColumn("stats", F.to_json(F.struct(*body)))


def profile_document(df: DataFrame, file_name: str, file_type: str, order_by: str | None = None,
                     external_metrics: str | None = None) -> DataFrame:
    """The document of one dataset; its rows are read by the value counts, the
    duplicate count and, where metric columns exist, the metric aggregate."""
    norm, specs = P._data_specs(df, [])
    key = F.lit(0).alias("__v")
    prof, hist, top = P.profile_of_counts(P.value_counts(norm, specs, [], include_nulls=True), specs)
    names = {n: i for i, n in enumerate(df.columns)}
    if P.metric_columns(df) and order_by is not None:
        place = F.create_map(*[x for n, i in names.items() for x in (F.lit(n), F.lit(i))])
        detected = P.custom_metrics(df, order_by).withColumn("position", place[F.col("metric")])
    else:
        detected = df.sparkSession.createDataFrame([], "metric string, latest double, max double, mean double, position int")
    metrics = merge_metrics(detected, external_metrics)
    doc = assemble(df.schema, prof.select(key, "*"), hist.select(key, "*"), top.select(key, "*"), P.duplicate_rows(df).select(key, "*"),
                   metrics.select(key, "*"), ["__v"], F.lit(file_name), file_type)
    return doc.drop("__v")


def read_index(spark: SparkSession, path: str, keys: str = "") -> DataFrame:
    """The documents of an index; ``keys`` is the schema text of further key columns."""
    return spark.read.schema(f"{keys}, {INDEX_SCHEMA}" if keys else INDEX_SCHEMA).parquet(path)


# -- back to the long form ------------------------------------------------------

def long_profile(documents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per (document, column) with the columns of ``profile_table``."""
    return documents.select(*(keys or []), F.inline("statistics")).select(*(keys or []), *P.PROFILE_COLUMNS)


def long_top_values(documents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = list(keys or [])
    return documents.select(*keys, F.inline("top_values")).select(*keys, "column", F.inline("values"))


def long_histogram(documents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, column, bin, lo, hi, n)."""
    keys = list(keys or [])
    return (documents.select(*keys, F.inline("distributions")).select(*keys, "column", "bin_edges", F.posexplode("counts").alias("bin", "n"))
            .select(*keys, "column", "bin", F.get("bin_edges", F.col("bin")).alias("lo"), F.get("bin_edges", F.col("bin") + 1).alias("hi"), "n"))


def long_metrics(documents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return documents.select(*(keys or []), F.inline("custom_metrics"))
