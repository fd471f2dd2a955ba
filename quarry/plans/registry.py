"""Registered queries (Spark side) and their DuckDB oracle SQL.

Every query reads the driver's tables (or catalog tables Spark derives from
them) in full.  Keys follow SURVEY §7.6.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import q_catalog, q_history, q_io, q_profile, q_reports, q_sketches

QueryFn = Callable[[SparkSession, str], DataFrame]
MODULES = (q_profile, q_sketches, q_catalog, q_history, q_reports, q_io)


def queries() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {}
    for mod in MODULES:
        out.update(mod.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for mod in MODULES:
        out.update(mod.ORACLE)
    return out
