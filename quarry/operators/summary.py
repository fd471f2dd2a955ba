"""Text reports.

Built from the long-form profile with aggregates over at most one row per
column (``min_by`` by ordinal, ``collect_list`` of schema-width lists): no
UDF, and the heavy work is the profile itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.clean import kind_of
from quarry.functions.text import capitalize, fixed2, float_text, thousands
from quarry.operators import profile as P

PREVIEW_COLUMNS = 5
PREVIEW_STATS = ["dtype", "mean", "std", "min", "max", "null_pct"]


def _one_row_join(frames: list[DataFrame]) -> DataFrame:
    keyed = [f.withColumn("__k", F.lit(1)) for f in frames]
    return reduce(lambda a, b: a.join(F.broadcast(b), "__k"), keyed).drop("__k")


def _top_text(df: DataFrame, k: int = 5) -> DataFrame:
    """(column, ordinal, top_values) with 'value:n' items in rank order."""
    tv = P.top_values(df, k=k)
    items = F.array_sort(F.collect_list(F.struct(
        "rank", F.concat("value", F.lit(":"), F.col("n").cast("string")).alias("t"))))
    return (tv.groupBy("column").agg(F.concat_ws(", ", F.transform(items, lambda e: e["t"]))
                                     .alias("top_values")))


def stats_preview(df: DataFrame, prof: DataFrame | None = None) -> DataFrame:
    """the first five columns with dtype, mean, std, min, max, null_pct, top values."""
    df = df.select(*[F.col(f"`{c}`") for c in df.columns[:PREVIEW_COLUMNS]])  # the others are not read
    first = prof.where(F.col("ordinal") < PREVIEW_COLUMNS) if prof is not None else P.profile_table(df)
    return (first.join(_top_text(df), "column", "left")
                 .select("column", "ordinal", *PREVIEW_STATS, "top_values",
                         (F.col("null_pct") > 0).alias("null_alert")))


def _num(c):
    return F.when(F.col(c).isNull(), F.lit("n/a")).otherwise(F.format_string("%.6f", F.col(c)))


def profile_context(df: DataFrame, file_name: str, file_type: str,
                    prof: DataFrame | None = None) -> DataFrame:
    """Compact context text of a profile (header + one line per preview column)."""
    prev = stats_preview(df, prof)
    line = F.concat(
        F.lit("- "), F.col("column"), F.lit(" ("), F.col("dtype"), F.lit("): mean="), _num("mean"),
        F.lit(", std="), _num("std"), F.lit(", min="), _num("min"), F.lit(", max="), _num("max"),
        F.lit(", null_pct="), _num("null_pct"),
        F.when(F.col("top_values").isNotNull(), F.concat(F.lit(", top="), F.col("top_values")))
         .otherwise(F.lit("")))
    lines = (prev.agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("l")))).alias("ls"))
                 .select(F.array_join(F.transform("ls", lambda e: e["l"]), "\n").alias("lines")))
    head = df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("cols"))
    out = _one_row_join([head, lines])
    return out.select(
        F.lit(file_name).alias("file_name"),
        F.concat(F.lit(f"Dataset: {file_name} ({file_type.upper()})\nRows: "),
                 F.col("rows").cast("string"), F.lit(", Columns: "), F.col("cols").cast("string"),
                 F.lit("\nStatistics:\n"), F.col("lines")).alias("context"))


def _metrics_text(df: DataFrame, order_by: str | None, external_metrics: str | None):
    """One-row frame with ``mt``: the metric sentences in merge order.

    Detected metrics (dicts with a peak) come first in column order; metrics
    supplied as a JSON object override them by name (U4: the supplied value
    wins and keeps the detected position) or follow in their own order.  A
    supplied object with ``max`` reads as a peak, a supplied scalar as
    ``Name: value.``; other supplied values add nothing.
    """
    spark = df.sparkSession
    frames = []
    if order_by is not None and P.metric_columns(df):
        order = {name: i for i, name in enumerate(df.columns)}
        pos = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
        frames.append(P.custom_metrics(df, order_by).select(
            "metric", pos[F.col("metric")].cast("long").alias("dpos"),
            F.concat(F.lit(" Recorded '"), F.col("metric"), F.lit("' peak: "),
                     float_text(F.col("max")), F.lit(".")).alias("dt")))
    if external_metrics:
        entries = F.posexplode(F.map_entries(F.from_json(F.lit(external_metrics),
                                                         "map<string,string>")))
        ext = spark.range(1).select(entries).select(
            F.col("col.key").alias("metric"), F.col("pos").cast("long").alias("epos"),
            F.col("col.value").alias("raw"))
        peak = F.get_json_object(F.col("raw"), "$.max")
        is_obj = F.ltrim(F.col("raw")).startswith("{")
        is_list = F.ltrim(F.col("raw")).startswith("[")
        text = (F.when(is_obj & peak.isNotNull(),
                       F.concat(F.lit(" Recorded '"), F.col("metric"), F.lit("' peak: "), peak,
                                F.lit(".")))
                 .when(is_obj | is_list | F.col("raw").isNull(), F.lit(""))
                 .otherwise(F.concat(F.lit(" "), capitalize(F.col("metric")), F.lit(": "),
                                     F.col("raw"), F.lit("."))))
        frames.append(ext.select("metric", "epos", text.alias("et")))
    if not frames:
        return None
    if len(frames) == 1:
        f = frames[0]
        p, t = ("dpos", "dt") if "dpos" in f.columns else ("epos", "et")
        merged = f.select(F.col(p).alias("p"), F.col(t).alias("t"))
    else:
        merged = (frames[0].join(frames[1], "metric", "full_outer")
                  .select(F.coalesce(F.col("dpos"), F.lit(1 << 20) + F.col("epos")).alias("p"),
                          F.coalesce(F.col("et"), F.col("dt")).alias("t")))
    return merged.agg(F.array_sort(F.collect_list(F.struct("p", "t"))).alias("mt"))


def rule_summary(df: DataFrame, file_name: str, file_type: str, order_by: str | None = None,
                 external_metrics: str | None = None, prof: DataFrame | None = None) -> DataFrame:
    """One-sentence report of a dataset (rows, columns, first numeric column's
    mean and range, first categorical column's top value, up to two high-null
    columns, metric peaks and supplied metric values).  ``prof``: an already
    computed :func:`profile_table` of ``df`` to reuse, else the light profile."""
    prof = prof if prof is not None else P.light_profile(df)
    cats = [f.name for f in df.schema.fields if kind_of(f.dataType) in ("string", "bool")]
    # one aggregate over the profile, so that it is planned once
    parts = [prof.agg(*summary_parts(cats))]
    metrics_txt = F.lit("")
    mt = _metrics_text(df, order_by, external_metrics)
    if mt is not None:
        parts.append(mt)
        metrics_txt = F.coalesce(F.array_join(F.transform("mt", lambda e: e["t"]), ""), F.lit(""))
    one = _one_row_join(parts)
    text = summary_text(F.lit(file_name), F.lit(file_type), len(df.columns), metrics_txt)
    return one.select(F.lit(file_name).alias("file_name"), text.alias("summary"))


def summary_parts(categorical: list[str]) -> list[Column]:
    """Aggregates over a profile that :func:`summary_text` reads: rows, first numeric
    column, top value of the first categorical column (its mode), high-null columns."""
    top = F.col("column").isin(categorical) & F.col("mode").isNotNull()
    high = F.struct("ordinal", F.concat("column", F.lit(" ("), F.col("null_pct").cast("string"), F.lit("%)")).alias("t"))
    return [
        F.max("row_count").alias("rows"),
        F.min_by(F.struct("column", "mean", "min", "max"), F.when(F.col("mean").isNotNull(), F.col("ordinal"))).alias("nm"),
        F.min_by(F.struct("column", F.col("mode").alias("value")), F.when(top, F.col("ordinal"))).alias("tv"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("null_pct") > 5, high))), 1, 2).alias("hn")]


def summary_text(file_name: Column, file_type: Column, columns: int, metrics: Column) -> Column:
    """The report sentence from the columns of :func:`summary_parts`."""
    num_txt = F.when(F.col("nm").isNotNull(), F.concat(
        F.lit(" Notably, '"), F.col("nm.column"), F.lit("' averages "), fixed2(F.col("nm.mean")),
        F.lit(" (range: "), float_text(F.col("nm.min")), F.lit(" to "),
        float_text(F.col("nm.max")), F.lit(")."))).otherwise(F.lit(""))
    cat_txt = F.when(F.col("tv").isNotNull(), F.concat(
        F.lit(" The most frequent '"), F.col("tv.column"), F.lit("' is '"), F.col("tv.value"),
        F.lit("'."))).otherwise(F.lit(""))
    null_txt = F.when(F.size("hn") > 0, F.concat(
        F.lit(" Quality issues: High nulls in "),
        F.array_join(F.transform("hn", lambda e: e["t"]), ", "), F.lit(".")
    )).otherwise(F.lit(" Data quality appears robust with minimal nulls."))
    return F.trim(F.concat(thousands(F.col("rows")), F.lit(f" rows, {columns} cols. "), file_name, F.lit(" ("), F.upper(file_type),
                           F.lit(") focus."), num_txt, cat_txt, null_txt, metrics))
