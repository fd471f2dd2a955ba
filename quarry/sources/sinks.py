"""Sinks (S8-S10): appends to the metadata index / audit table, JSON output.

Paths are folders on the shared storage the cluster names in
``spark.checkpoint.dir`` (or any path the caller gives); nothing is written
to a machine-local folder on a cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_dir, shuffle_partitions


def new_location(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared scratch area."""
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def index_append(docs: DataFrame, path: str, partition_by: str | None = "file_type") -> str:
    """Append profile documents to the metadata index (Parquet, partitioned)."""
    w = docs.write.mode("append")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return path


def audit_append(rows: DataFrame, path: str) -> str:
    """Append audit rows (Parquet, partitioned by action)."""
    rows.write.mode("append").partitionBy("action").parquet(path)
    return path


def json_sink(df: DataFrame, path: str) -> str:
    """Machine-readable JSON lines of any result."""
    df.write.mode("overwrite").json(path)
    return path


def export_version(df: DataFrame, path: str, file_type: str) -> str:
    """Write a resolved version out in its own format (csv with header,
    json lines, parquet)."""
    t = file_type.lower().strip(".")
    w = df.write.mode("overwrite")
    if t == "csv":
        w.option("header", True).csv(path)
    elif t == "json":
        w.json(path)
    elif t in ("parquet", "pq"):
        w.parquet(path)
    else:
        raise ValueError(f"Unsupported file type: {t}")
    return path


def _file_writer(folder: str, key: str):
    """Rows (key, text) sorted by key in, one row a file out; a closure, so that tasks need no import of this package."""
    base = "/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder

    def run(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        home = f"{base}/part={task.partitionId()}"
        spare = f"{home}/.{task.taskAttemptId()}.tmp"  # hidden until its last line is in
        f = name = None
        done = 0
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = f"{home}/{key}={'__HIVE_DEFAULT_PARTITION__' if k is None else k}.txt"
                if here != name:
                    if f is not None:
                        f.close()
                        os.replace(spare, name)
                    os.makedirs(home, exist_ok=True)
                    f, name, done = open(spare, "wb"), here, done + 1
                f.write((text or "").encode() + b"\n")
        if f is not None:
            f.close()
            os.replace(spare, name)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["files"])
    return run


def text_files(rows: DataFrame, folder: str, key: str, text: str) -> str:
    """One text file per integer ``key``, ``<key>=<value>.txt``, holding its rows of ``text`` line by line.

    A folder per task, not per file, and files written in place by their
    task: no renames by the driver, whatever the number of files.  Where tasks
    cannot open the folder themselves, Spark's own writer makes a folder per file.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(key), F.col(text))
    whole = folder if ":" in folder else spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if not whole.startswith("file:"):
        rows.repartition(key).write.partitionBy(key).text(folder)
        return folder
    (rows.repartition(shuffle_partitions(spark), key).sortWithinPartitions(key)
         .mapInArrow(_file_writer(folder, key), "files long").agg(F.sum("files")).collect())
    return folder


def as_json_text(df: DataFrame) -> DataFrame:
    """S10 as a column: one JSON object per row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
