"""Metrics as typed columns of the metadata index, so that metric filters reach the scan.

Records come with their metrics as JSON text.  When they are appended to the
index, the most frequent metric names (``MOST``) get two columns each: the
number that the filter compares (an object's ``latest``, a number, a boolean
as 1 or 0), null where there is none, and a mark where the metric is there but
is no number.  A condition then is a plain comparison that Parquet statistics
can answer: ``m > x``, or, if a missing metric (which counts as 0) meets it,
``(m is null and mark is null) or m < x``.  Files written before a name was
known lack its columns and read as null, which is "missing", so appends with
new names need no rewrite.  Names without columns are read from the JSON text
by the old rule; nothing is lost, they are only not pushed down.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.metricql import _compare, metric_number, metric_value, metrics_map, parse

MOST = 32
FIELDS = {"file_name": "string", "file_type": "string", "row_count": "bigint", "column_count": "bigint"}
_NAME = re.compile(r"[a-zA-Z_0-9]+")  # what a condition can name


def value_column(name: str) -> str:
    """Column of a metric's number; the check sum keeps names apart that differ in case only."""
    return f"metric_{name}_{zlib.crc32(name.encode()):08x}"


def mark_column(name: str) -> str:
    return f"{value_column(name)}_other"


def frequent_names(records: DataFrame, most: int = MOST, stats: str = "stats") -> list[str]:
    """The ``most`` most frequent metric names that a condition can name (ties by name)."""
    keys = records.select(F.explode(F.map_keys(metrics_map(F.col(stats)))).alias("k"))
    rows = (keys.where(F.col("k").rlike(f"^{_NAME.pattern}$")).groupBy("k").count()
            .orderBy(F.col("count").desc(), "k").limit(most).collect())
    return [r["k"] for r in rows]


def with_metric_columns(records: DataFrame, names: list[str], stats: str = "stats") -> DataFrame:
    """``records`` with the fields and metrics of their JSON as typed columns.

    The JSON is parsed once a row and each metric that a row has is read once, however many names there are.
    """
    fields = ", ".join(f"{k}: string" for k in FIELDS)
    parsed = records.withColumn("__p", F.from_json(stats, f"struct<{fields}, custom_metrics: map<string,string>>"))
    m = F.coalesce(F.col("__p.custom_metrics"), F.create_map().cast("map<string,string>"))
    out = parsed.withColumns({k: F.col(f"__p.{k}").try_cast(t) for k, t in FIELDS.items()})
    out = out.withColumn("__m", F.transform_values(m, lambda _, raw: F.struct(metric_number(raw).alias("v")))).drop("__p")
    typed = {}
    for n in names:
        entry = F.col("__m").getItem(n)
        typed |= {value_column(n): entry["v"], mark_column(n): F.when(entry.isNotNull() & entry["v"].isNull(), F.lit(True))}
    return out.withColumns(typed).drop("__m")


def is_indexed(records: DataFrame) -> bool:
    return any(c.startswith("metric_") and c.endswith("_other") for c in records.columns)


def metric_condition(records: DataFrame, expr: str | None, strict: bool = False, stats: str = "stats") -> Column:
    """The filter of ``expr`` over an index, by its typed columns where it has them."""
    if expr is None or not expr.strip():
        return F.lit(True)
    have = set(records.columns)

    def one(key: str, op: str, number: float | None) -> Column:
        if number is None:
            return F.lit(False)
        if mark_column(key) not in have:
            return F.coalesce(_compare(metric_value(metrics_map(F.col(stats)), key), op, number), F.lit(False))
        value, mark = F.col(value_column(key)), F.col(mark_column(key))
        test = _compare(value, op, number)
        zero = {">": 0 > number, "<": 0 < number, ">=": 0 >= number, "<=": 0 <= number, "==": number == 0}[op]
        return (value.isNull() & mark.isNull()) | test if zero else test
    groups = [reduce(lambda a, b: a & b, [one(*c) for c in conds], F.lit(True)) if conds else F.lit(True) for conds in parse(expr, strict)]
    return reduce(lambda a, b: a | b, groups)


def append_metadata(records: DataFrame, path: str, most: int = MOST, names: list[str] | None = None) -> list[str]:
    """Append records (with JSON ``stats``) to the index, partitioned by file type; returns the names that got columns."""
    names = frequent_names(records, most) if names is None else names
    with_metric_columns(records, names).write.mode("append").partitionBy("file_type").parquet(path)
    return names


def read_metadata(spark, path: str) -> DataFrame:
    """The index; files that lack a metric's columns read as missing."""
    return spark.read.option("mergeSchema", True).parquet(path)
