"""The indexes of the registered queries: each dataset version is profiled and stored once per session,
and so are the metadata records.

The reference profiles a version when it is committed and answers every later
question from the stored document; so do these queries.  The index lies under
the session's shared folder; if that folder has been emptied, documents are
made again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import documents as D
from quarry.operators import metric_index as M
from quarry.plans.catalog import Catalog
from quarry.sources import sinks as K
from quarry.sources.tables import table

# Two versions of the orders data set: the 1995 orders without the priority
# column, and the 1996 orders with every column.
YEAR_A, YEAR_B = 1995, 1996
EXTERNAL_METRICS = '{"score": 0.99, "optimizer": "adam", "lr": 0.001}'

_INDEX: dict[tuple[str, str], str] = {}


def version(spark: SparkSession, sf: str, year: int, drop=()) -> DataFrame:
    return table(spark, sf, "orders").where(F.year("o_orderdate") == year).drop(*drop)


def events_scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumnRenamed("value", "score")


DATASETS = {
    f"orders_{YEAR_A}.parquet": lambda spark, sf: (version(spark, sf, YEAR_A, drop=("o_orderpriority",)), {}),
    f"orders_{YEAR_B}.parquet": lambda spark, sf: (version(spark, sf, YEAR_B), {}),
    "lineitem.parquet": lambda spark, sf: (table(spark, sf, "lineitem"), {}),
    "events.parquet": lambda spark, sf: (events_scored(spark, sf), {"order_by": "event_id", "external_metrics": EXTERNAL_METRICS}),
}


def stored_document(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The stored document of a dataset version; made and appended to the index at the first call."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    path = _INDEX.get(key)
    if path is not None:
        try:
            found = D.read_index(spark, path).where(F.col("file_name") == name)
            if not found.isEmpty():
                return found
        except AnalysisException:  # the folder is gone
            path = None
    path = _INDEX[key] = path or K.new_location(spark, "profile-index")
    df, options = DATASETS[name](spark, sf)
    K.index_append(D.profile_document(df, name, "parquet", **options), path)
    return D.read_index(spark, path).where(F.col("file_name") == name)


_METADATA: dict[tuple[str, str], str] = {}


def stored_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """The derived metadata records in an index with typed metric columns; written at the first call."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key in _METADATA:
        try:
            return M.read_metadata(spark, _METADATA[key])
        except AnalysisException:  # the folder is gone
            pass
    path = K.new_location(spark, "metadata-index")
    M.append_metadata(Catalog(spark, sf).metadata, path)
    _METADATA[key] = path
    return M.read_metadata(spark, path)
