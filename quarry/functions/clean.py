"""Value normalisation and dtype classes used by every profile operator.

The classification is planning over the schema (driver side, no data moves):

* numeric      - integral, fractional and decimal types, boolean excluded
* categorical  - string and boolean (and nested types, profiled as JSON text)
* histogram    - numeric plus boolean (booleans as 0/1)
* anything else (dates, timestamps, binary) gets the base statistics only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text tokens a CSV reader of the reference treats as
# missing (pandas' default ``na_values``), written out in natural order.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Lower-case name fragments that mark a model metric column.
METRIC_KEYWORDS = [
    "accuracy", "f1", "loss", "precision", "recall", "auc", "mse", "mae",
    "rmse", "score",
]

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    ordinal: int
    dtype: str
    kind: str  # 'integral' | 'fractional' | 'bool' | 'string' | 'other'

    @property
    def numeric(self) -> bool:
        return self.kind in ("integral", "fractional")

    @property
    def categorical(self) -> bool:
        return self.kind in ("string", "bool")

    @property
    def histogram(self) -> bool:
        return self.kind in ("integral", "fractional", "bool")


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, INTEGRAL):
        return "integral"
    if isinstance(dt, FRACTIONAL) or isinstance(dt, T.DecimalType):
        return "fractional"
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)) or isinstance(dt, NESTED):
        return "string"
    return "other"


def column_specs(df: DataFrame) -> list[ColumnSpec]:
    return [ColumnSpec(f.name, i, f.dataType.simpleString(), kind_of(f.dataType))
            for i, f in enumerate(df.schema.fields)]


def normalized(df: DataFrame) -> DataFrame:
    """NaN -> NULL on floating columns, nested -> JSON text; decimals stay exact.

    After this every missing value is a NULL, which is what the profile
    counts as missing (a NaN is missing for the reference too).
    """
    return normalized_with(df, [])


def normalized_with(df: DataFrame, more: list[Column]) -> DataFrame:
    """:func:`normalized` with further columns behind it (such as file metadata)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt = f.dataType
        if isinstance(dt, FRACTIONAL):
            c = F.when(F.isnan(c), F.lit(None).cast(dt)).otherwise(c)
        elif isinstance(dt, NESTED):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out, *more)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in floating columns only."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, FRACTIONAL):
            c = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def na_tokens_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn the reader's missing-value tokens into NULL on string columns (C14)."""
    tokens = F.array(*[F.lit(t) for t in NA_TOKENS])
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns):
            c = F.when(F.array_contains(tokens, c), F.lit(None).cast("string")).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def is_metric_name(name: str) -> bool:
    low = name.lower()
    return any(k in low for k in METRIC_KEYWORDS)


def metric_name_column(name_col: Column) -> Column:
    """Column form of :func:`is_metric_name` (C19) for a column of names."""
    low = F.lower(name_col)
    cond = F.lit(False)
    for k in METRIC_KEYWORDS:
        cond = cond | low.contains(k)
    return cond


def bool_text(c: Column) -> Column:
    """Render a boolean the way the reference's text keys show it."""
    return F.when(c, F.lit("True")).when(~c, F.lit("False"))
