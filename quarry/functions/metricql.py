"""Metric predicates over the JSON metrics of metadata records.

The expression text is read on the driver (it is a parameter, not data) and
becomes one boolean ``Column``; the per-row evaluation is JSON extraction and
a comparison, all built-in.

Semantics kept from the reference:

* conditions are separated by commas and combined with AND;
* a condition is searched (unanchored) with the pattern below; a condition in
  which the pattern is not found is skipped (true);
* a metric that is a JSON object compares by its ``latest`` field (absent
  ``latest`` -> 0); a metric missing from the record compares as 0;
* a value that is not a number (text, JSON null) makes the record not match,
  as does a number literal that does not parse (``1.2.3``).

Extension (README only in the reference): groups of conditions joined by
``OR`` (any case) are OR-ed; ``strict=True`` raises on a condition the
pattern cannot read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the condition pattern of the reference's metric filter.
CONDITION = re.compile(r"([a-zA-Z_0-9]+)\s*(>|<|>=|<=|==)\s*([0-9.]+)")
# Strict mode reads a whole condition and also signed / scientific numbers.
STRICT_CONDITION = re.compile(
    r"\s*([a-zA-Z_0-9]+)\s*(>=|<=|==|>|<)\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\s*")
OR_SPLIT = re.compile(r"\s+OR\s+", re.IGNORECASE)


def parse(expr: str, strict: bool = False) -> list[list[tuple[str, str, float | None]]]:
    """Expression -> OR-groups of (key, op, value); value None = unparsable.

    Default: the reference's unanchored search (unreadable conditions are
    skipped).  ``strict=True``: every condition must be a whole
    ``key op number`` (signed and scientific numbers allowed) or ValueError.
    """
    groups = []
    for part in OR_SPLIT.split(expr.strip()):
        conds = []
        for raw in (c.strip() for c in part.split(",")):
            if strict:
                m = STRICT_CONDITION.fullmatch(raw)
                if not m:
                    raise ValueError(f"cannot read metric condition {raw!r}")
                key, op, val = m.groups()
                conds.append((key, op, float(val)))
                continue
            m = CONDITION.search(raw)
            if not m:
                continue
            key, op, val = m.groups()
            try:
                num = float(val)
            except ValueError:
                num = None
            conds.append((key, op, num))
        groups.append(conds)
    return groups


def metrics_map(stats_json: Column, field: str = "custom_metrics") -> Column:
    """The metrics object of a stats JSON document as map<string,string>,
    parsed once (nested objects stay JSON text)."""
    return F.from_json(stats_json, f"struct<{field}:map<string,string>>")[field]


def _number(raw: Column) -> Column:
    """JSON scalar text as a double: numbers, and booleans as 1 and 0; no type suffixes."""
    return (F.when(raw == "true", F.lit(1.0)).when(raw == "false", F.lit(0.0))
             .when(~raw.rlike(r"[0-9.]\s*[dDfF]\s*$"), raw.try_cast("double")))


def metric_number(raw: Column) -> Column:
    """Number of a metric that is there, from its JSON text: an object's ``latest`` (0 without one) or a scalar."""
    inner = F.from_json(raw, "map<string,string>")
    is_obj = F.ltrim(raw).startswith("{")
    latest = F.when(F.coalesce(F.map_contains_key(inner, "latest"), F.lit(False)),
                    _number(inner.getItem("latest"))).otherwise(F.lit(0.0))
    return F.when(is_obj, latest).otherwise(_number(raw))


def metric_value(m: Column, key: str) -> Column:
    """Numeric value of metric ``key`` in a parsed metrics map, reference rules."""
    present = F.coalesce(F.map_contains_key(m, key), F.lit(False))
    return F.when(~present, F.lit(0.0)).otherwise(metric_number(m.getItem(key)))


def _compare(v: Column, op: str, num: float) -> Column:
    lit = F.lit(num)
    return {">": v > lit, "<": v < lit, ">=": v >= lit, "<=": v <= lit, "==": v == lit}[op]


def _predicate_on(m: Column, groups) -> Column:
    ors = []
    for conds in groups:
        ands = []
        for key, op, num in conds:
            if num is None:
                ands.append(F.lit(False))
            else:
                ands.append(F.coalesce(_compare(metric_value(m, key), op, num), F.lit(False)))
        ors.append(reduce(lambda a, b: a & b, ands, F.lit(True)))
    return reduce(lambda a, b: a | b, ors)


def metric_predicate(expr: str | None, metrics: Column, strict: bool = False,
                     parsed: bool = False) -> Column:
    """Boolean column: do the record's metrics satisfy ``expr``.

    ``metrics`` is the metrics object as JSON text, or (``parsed=True``) as the
    map from :func:`metrics_map`.  The map is bound once per row as a lambda
    variable, so every condition reads the same parsed value; a NULL map reads
    as an empty one (every metric missing).
    """
    if expr is None or not expr.strip():
        return F.lit(True)
    groups = parse(expr, strict)
    m = metrics if parsed else F.from_json(metrics, "map<string,string>")
    return F.exists(F.array(m), lambda x: _predicate_on(x, groups))


# ---------------------------------------------------------------------------
# DuckDB twin, used by the oracle SQL
# ---------------------------------------------------------------------------

def metric_value_sql(metrics_json: str, key: str) -> str:
    j = f"json_extract({metrics_json}, '$.\"{key}\"')"
    return (f"(CASE WHEN {j} IS NULL THEN 0.0 "
            f"WHEN json_type({j}) = 'OBJECT' THEN "
            f"CASE WHEN json_extract({j}, '$.latest') IS NULL THEN 0.0 "
            f"ELSE TRY_CAST(json_extract_string({j}, '$.latest') AS DOUBLE) END "
            f"ELSE TRY_CAST(json_extract_string({metrics_json}, '$.\"{key}\"') AS DOUBLE) END)")


def metric_predicate_sql(expr: str | None, metrics_json: str) -> str:
    if expr is None or not expr.strip():
        return "TRUE"
    ors = []
    for conds in parse(expr):
        ands = []
        for key, op, num in conds:
            if num is None:
                ands.append("FALSE")
            else:
                sql_op = "=" if op == "==" else op
                ands.append(f"coalesce({metric_value_sql(metrics_json, key)} {sql_op} {num!r}, FALSE)")
        ors.append("(" + " AND ".join(ands or ["TRUE"]) + ")")
    return "(" + " OR ".join(ors) + ")"
