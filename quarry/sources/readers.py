"""Dataset readers.

``load_dataset`` dispatches on the file type the way the reference does
(explicit type first, else the path suffix; lower-cased, dots stripped;
``pq`` is Parquet; anything else is an error).

CSV: the reference's reader treats a fixed list of text tokens as missing and
infers types after that.  Spark's ``inferSchema`` runs before any token
handling (a numeric column holding ``NA`` would come back as text), so CSV is
read as text, the tokens become NULL, and the column types are inferred by
one aggregate over the data (per column: are all non-null values whole
numbers, decimal numbers or booleans?) - a one-row result of schema width.
Times stay text, as the reference leaves them, unless ``times=True``.  Quotes
are doubled inside quoted fields; quoted line ends need ``multiline=True`` (a
file is then read by one task); a row with more fields than the header, or an
open quote, raises.

JSON: JSON lines are the splittable default; a file that holds one JSON array
of records (the reference's upload format) is read with ``multiLine``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.clean import na_tokens_to_null, nan_to_null

SUPPORTED = ("csv", "json", "parquet", "pq")
# Upload file extensions the catalog accepts.
ALLOWED_EXTENSIONS = (".csv", ".json", ".parquet")

_BOOL_TRUE = ("True", "TRUE", "true")
_BOOL_FALSE = ("False", "FALSE", "false")
# A number as text: no type suffixes (Java reads 10d as 10.0).
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
SPECIAL = r"^\s*[+-]?(inf|infinity|nan)\s*$"


def text_to_double(c):
    """Text as a double, NULL unless it is a plain number."""
    return F.when(c.rlike(NUMBER) | F.lower(c).rlike(SPECIAL), c.try_cast("double"))


def resolve_type(path: str, file_type: str | None = None) -> str:
    suffix = (file_type or os.path.splitext(path.rstrip("/"))[1]).lower().strip(".")
    if suffix not in SUPPORTED:
        raise ValueError(f"Unsupported file type: {suffix}")
    return suffix


def infer_types(df: DataFrame, times: bool = False) -> DataFrame:
    """Cast text columns to the narrowest of bigint, double, boolean (and, if
    asked, timestamp_ntz) that holds every non-null value (else keep text)."""
    checks = []
    casts = {
        "bigint": lambda c: F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), c.try_cast("bigint")),
        "double": text_to_double,
        "boolean": lambda c: F.when(c.isin(*_BOOL_TRUE), F.lit(True))
                              .when(c.isin(*_BOOL_FALSE), F.lit(False)),
    }
    if times:
        casts["timestamp_ntz"] = lambda c: c.try_cast("timestamp_ntz")
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        checks.append(F.count(c).alias(f"c{i}_n"))
        for j, fn in enumerate(casts.values()):
            checks.append(F.count(fn(c)).alias(f"c{i}_t{j}"))
    counts = df.agg(*checks).first().asDict()  # one row, width = columns x 5
    out = []
    for i, name in enumerate(df.columns):
        n = counts[f"c{i}_n"]
        chosen = None
        for j, t in enumerate(casts):
            if n > 0 and counts[f"c{i}_t{j}"] == n:
                chosen = t
                break
        c = F.col(f"`{name}`")
        out.append((casts[chosen](c) if chosen else c).alias(name))
    return df.select(*out)


_BAD = "_bad_row"


def scan_csv(spark: SparkSession, path: str, multiline: bool = False, times: bool = False) -> DataFrame:
    reader = (spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
              .option("multiLine", multiline))
    names = reader.csv(path).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, _BAD])
    raw = (reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD)
           .option("enforceSchema", True).csv(path))
    # a short row is filled with nulls; a row with surplus fields or an open quote is an error
    quotes = F.length(_BAD) - F.length(F.replace(F.col(_BAD), F.lit('"'), F.lit("")))
    last = F.col(f"`{names[-1]}`") if names else F.lit(None)
    broken = F.col(_BAD).isNotNull() & (last.isNotNull() | (quotes % 2 == 1))
    first = F.when(broken, F.raise_error(F.concat(F.lit("malformed CSV row: "), F.substring(F.col(_BAD), 1, 200))).cast("string"))
    cells = [F.coalesce(first, F.col(f"`{n}`")).alias(n) if k == 0 else F.col(f"`{n}`") for k, n in enumerate(names)]
    return infer_types(na_tokens_to_null(raw.select(*cells)), times)


def scan_json(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """JSON lines or arrays of records; a folder that mixes both raises."""
    if multiline is None:
        # only an array's file has a line that starts with a bracket: records are objects
        bracket = F.substring(F.ltrim("value"), 1, 1) == "["
        heads = (spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("f"))
                 .agg(F.max(F.length(F.trim("value")) > 0).alias("some"), F.max(bracket).alias("array")).where("some")
                 .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("array"), 1)).alias("arrays")).first())
        if 0 < heads["arrays"] < heads["n"]:
            raise ValueError("the folder mixes JSON lines and JSON arrays; pass multiline explicitly")
        multiline = heads["arrays"] > 0
    return spark.read.option("multiLine", multiline).json(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_dataset(spark: SparkSession, path: str, file_type: str | None = None) -> DataFrame:
    """Read a CSV / JSON / Parquet dataset by explicit type or suffix."""
    t = resolve_type(path, file_type)
    if t == "csv":
        return scan_csv(spark, path)
    if t == "json":
        return scan_json(spark, path)
    return scan_parquet(spark, path)


def file_order(df: DataFrame):
    """Columns that give the file row order of a Parquet-backed DataFrame
    (``_metadata.file_path``, ``_metadata.row_index``), or None elsewhere."""
    cols = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        df.select(*cols).schema
    except Exception:  # not a Parquet scan: no row index
        return None
    return cols


def preview_rows(df: DataFrame, order_by: list[str] | None = None, n: int = 100) -> DataFrame:
    """The first ``n`` rows in a stable order, NaN shown as NULL.

    Without ``order_by`` the order is the file order (Parquet inputs), which
    is what "the first rows of the file" means.  ``orderBy().limit()`` plans as
    a top-k (TakeOrderedAndProject): each task keeps n rows, no full sort.
    """
    cols = [F.col(c) for c in order_by] if order_by else file_order(df)
    if cols is None:
        raise ValueError("order_by is needed for inputs without a file row order")
    return nan_to_null(df.orderBy(*cols).limit(n))
