"""DuckDB oracle SQL for the profile operators.

These strings are the independent check of :mod:`quarry.operators.profile`:
plain aggregates (``count(DISTINCT)``, ``quantile_cont``, ``kurtosis_pop``,
population skewness from its definition), evaluated by DuckDB on the same
parquet tables.  They are generated from a column list only because one
SELECT per profiled column is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from quarry.functions.numeric import exact_mean_sql, round_sql


@dataclass(frozen=True)
class Col:
    name: str
    kind: str  # integral | fractional | bool | string | other
    dtype: str  # Spark simpleString, reported as-is


def _text(c: Col, ref: str) -> str:
    if c.kind == "bool":
        return f"CASE WHEN {ref} THEN 'True' ELSE 'False' END"
    return f"CAST({ref} AS VARCHAR)"


def _keys_sel(keys, prefix=""):
    return "".join(f"{prefix}{k}, " for k in keys)


def profile_sql(table: str, cols: list[Col], keys: list[str] | None = None,
                source: str | None = None) -> str:
    keys = list(keys or [])
    src = source or table
    parts = []
    for i, c in enumerate(cols):
        numeric = c.kind in ("integral", "fractional")
        x = f"CAST({c.name} AS DOUBLE)" if numeric else c.name
        part_by = f"PARTITION BY {', '.join(keys)}" if keys else ""
        inner = (f"SELECT {_keys_sel(keys)}{c.name} AS v, {x} AS x"
                 + (f", avg({x}) OVER ({part_by}) AS mu" if numeric else "")
                 + f" FROM {src}")
        if numeric:
            stats = (f"{exact_mean_sql('x')} AS mean, {round_sql('stddev_samp(x)', 6)} AS std, "
                     f"{round_sql('min(x)', 6)} AS min, {round_sql('max(x)', 6)} AS max, "
                     f"{round_sql('quantile_cont(x, 0.5)', 6)} AS median, "
                     f"{round_sql('quantile_cont(x, 0.25)', 6)} AS q1, "
                     f"{round_sql('quantile_cont(x, 0.75)', 6)} AS q3, "
                     f"{round_sql('avg(pow(x - mu, 3)) / pow(stddev_pop(x), 3)', 4)} AS skewness, "
                     f"{round_sql('kurtosis_pop(x)', 4)} AS kurtosis")
        else:
            stats = ", ".join(f"CAST(NULL AS DOUBLE) AS {m}" for m in
                              ["mean", "std", "min", "max", "median", "q1", "q3",
                               "skewness", "kurtosis"])
        order_v = "v"
        mode_cte = (f"SELECT {_keys_sel(keys)}{_text(c, 'v')} AS mode, row_number() OVER ("
                    f"{part_by} ORDER BY count(*) DESC, {order_v}) AS rn "
                    f"FROM ({inner}) WHERE v IS NOT NULL GROUP BY {_keys_sel(keys)}v")
        main = (f"SELECT {_keys_sel(keys)}'{c.name}' AS \"column\", CAST({i} AS INTEGER) AS ordinal, "
                f"'{c.dtype}' AS dtype, count(*) AS row_count, "
                f"count(*) - count(v) AS null_count, "
                f"{round_sql('(count(*) - count(v)) / count(*) * 100', 2)} AS null_pct, "
                f"count(DISTINCT v) AS unique_count, {stats} "
                f"FROM ({inner}) {'GROUP BY ' + ', '.join(keys) if keys else ''}")
        if keys:
            on = " AND ".join(f"m.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)
            parts.append(f"SELECT p.*, m.mode FROM ({main}) p LEFT JOIN "
                         f"(SELECT * FROM ({mode_cte}) WHERE rn = 1) m ON {on}")
        else:
            parts.append(f"SELECT p.*, (SELECT mode FROM ({mode_cte}) WHERE rn = 1) AS mode "
                         f"FROM ({main}) p")
    return "\nUNION ALL\n".join(parts)


def top_values_sql(table: str, cols: list[Col], k: int = 5) -> str:
    parts = []
    for c in cols:
        if c.kind not in ("string", "bool"):
            continue
        parts.append(
            f"SELECT '{c.name}' AS \"column\", CAST(rank AS INTEGER) AS rank, value, n FROM ("
            f"SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM ("
            f"SELECT {_text(c, c.name)} AS value, count(*) AS n FROM {table} "
            f"WHERE {c.name} IS NOT NULL GROUP BY 1)) WHERE rank <= {k}")
    return "\nUNION ALL\n".join(parts)


def mode_sql(table: str, cols: list[Col]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c.name}' AS \"column\", mode, mode_count FROM ("
            f"SELECT {_text(c, 'v')} AS mode, n AS mode_count, "
            f"row_number() OVER (ORDER BY n DESC, v) AS rn FROM ("
            f"SELECT {c.name} AS v, count(*) AS n FROM {table} WHERE {c.name} IS NOT NULL "
            f"GROUP BY 1)) WHERE rn = 1")
    return "\nUNION ALL\n".join(parts)


def histogram_sql(table: str, cols: list[Col], bins: int = 10) -> str:
    parts = []
    for c in cols:
        if c.kind not in ("integral", "fractional", "bool"):
            continue
        x = f"CAST(CAST({c.name} AS INTEGER) AS DOUBLE)" if c.kind == "bool" else f"CAST({c.name} AS DOUBLE)"
        parts.append(f"""SELECT * FROM (
  WITH vals AS (SELECT {x} AS x FROM {table} WHERE {c.name} IS NOT NULL),
  s AS (SELECT min(x) AS mn0, max(x) AS mx0, count(*) AS nv FROM vals),
  r AS (SELECT CASE WHEN mn0 = mx0 THEN mn0 - 0.5 ELSE mn0 END AS mn,
               CASE WHEN mn0 = mx0 THEN mx0 + 0.5 ELSE mx0 END AS mx FROM s WHERE nv >= 2),
  e AS (SELECT CAST(b.range AS INTEGER) AS bin,
               CAST(b.range AS DOUBLE) * ((mx - mn) / {float(bins)}) + mn AS lo,
               CASE WHEN b.range = {bins - 1} THEN mx
                    ELSE CAST(b.range + 1 AS DOUBLE) * ((mx - mn) / {float(bins)}) + mn END AS hi
        FROM r, range({bins}) b)
  SELECT '{c.name}' AS "column", e.bin, {round_sql('e.lo', 4)} AS lo, {round_sql('e.hi', 4)} AS hi,
         count(vals.x) AS n
  FROM e LEFT JOIN vals ON (vals.x >= e.lo AND vals.x < e.hi) OR (e.bin = {bins - 1} AND vals.x = e.hi)
  GROUP BY e.bin, e.lo, e.hi)""")
    return "\nUNION ALL\n".join(parts)
