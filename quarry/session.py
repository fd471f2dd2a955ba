"""SparkSession construction and session-level helpers.

Everything in the library takes a session from the caller; this module only
builds one for tests, the bench and the command line, with the settings the
plans rely on (AQE with skew-join splitting, UTC session time zone, no UI).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every plan in the library assumes.  AQE re-plans joins from
# runtime sizes (the broadcast decision for tables whose size grows with the
# data is taken there, after the size is known) and splits skewed
# sort-merge-join partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.exchange.reuse": "true",
    # Checkpoint files of data no longer referenced are deleted.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with the library's base settings."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("QUARRY_SHUFFLE_PARTITIONS", cpus))
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(parts)
    conf["spark.driver.memory"] = os.environ.get("QUARRY_DRIVER_MEMORY", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is a shared folder chosen by the operator and is only
    read here.  Only on a local master without the setting (tests) a fresh
    scratch folder is created and set; elsewhere a missing setting raises.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # a remote session: the server owns the setting
        sc = None
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current:
        master = sc.master if sc is not None else ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="quarry-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
        if sc is not None:
            sc.setCheckpointDir(current)
    elif sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
