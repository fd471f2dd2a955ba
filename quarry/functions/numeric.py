"""Deterministic rounding of aggregates.

A floating-point ``avg`` depends on the order in which partial sums are
merged, which on a cluster is the order shuffle blocks arrive.  Means of
decimal-like data (prices with two decimals) often sit exactly on a rounding
tie at the 6th digit, so that order would decide the reported digit.  The mean
is therefore an exact, order-independent decimal sum: every value as a decimal
with nine digits after the point, summed as decimal(38,9) (decimal(38,0) for
whole numbers), turned into a whole number of 1e-9 units, divided by the count
and rounded half-up once.  Totals fit up to 1e25 (1e38 for whole numbers), so
the rule does not change with the number of rows.  Only values of 1e15 and
above in magnitude, whose doubles carry no more digits than the result, and
non-finite ones make the floating-point mean take over.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_DIGITS = 9
LARGEST = 1e15
_BILLION = Decimal(10 ** UNIT_DIGITS)


def exact_units(x: Column, integral: bool = False) -> Column:
    """``x`` as an exact decimal, NULL when it is too large for one."""
    if integral:
        return x.cast("decimal(20,0)")
    return F.when(F.abs(x.cast("double")) < LARGEST, x.cast("decimal(24,9)"))


def unit_mean(total: Column, n: Column, integral: bool = False) -> Column:
    """``total / n`` rounded half-up to 6 digits, from an exact decimal total."""
    count = n.cast("decimal(19,0)")
    if integral:
        return F.try_divide(total.cast("decimal(38,0)"), count.cast("decimal(38,0)"))
    t = total.try_cast("decimal(34,9)")
    whole = F.floor(t)
    part = (t - whole).cast("decimal(10,9)") * F.lit(_BILLION)
    units = whole.cast("decimal(26,0)") * F.lit(_BILLION) + part.cast("decimal(10,0)")
    return F.try_divide(units.cast("decimal(38,0)"), (count * F.lit(_BILLION)).cast("decimal(38,0)"))


def mean_parts(x: Column, integral: bool = False) -> list[Column]:
    """Aggregates from which :func:`mean_from_parts` builds the mean: the exact
    sum, the counts of exact and of all values, and the floating mean."""
    u = exact_units(x, integral)
    return [F.try_sum(u), F.count(u), F.count(x), F.avg(x.cast("double"))]


def mean_from_parts(isum: Column, n_units: Column, n: Column, fmean: Column,
                    integral: bool = False) -> tuple[Column, Column]:
    """(mean rounded half-up to 6 digits, floating mean for centring)."""
    ok = (n_units == n) & isum.isNotNull() & (n > 0)
    rounded = F.when(ok, F.round(unit_mean(isum, n, integral), 6).cast("double")).otherwise(F.round(fmean, 6))
    return rounded, fmean


def exact_mean(x: Column, integral: bool = False) -> Column:
    """Aggregate: mean of ``x``, from an exact sum, rounded half-up to 6 digits."""
    isum, n_units, n, fmean = mean_parts(x, integral)
    return mean_from_parts(isum, n_units, n, fmean, integral)[0]


MEAN_SCALE = 12


def exact_mean_sql(x: str) -> str:
    """DuckDB twin of :func:`exact_mean`: exact sum in HUGEINT units of 1e-12,
    divided by the count with half-up rounding at 6 digits (equal to the
    Spark result whenever the values have at most 9 decimals)."""
    s = f"CAST(sum(CAST({x} AS DECIMAL(38,{MEAN_SCALE}))) * 1000000000000 AS HUGEINT)"
    n = f"CAST(count({x}) AS HUGEINT) * 1000000"
    return (f"(CASE WHEN count({x}) = 0 THEN NULL ELSE "
            f"CAST(sign({s}) * ((2 * abs({s}) + {n}) // (2 * {n})) AS DOUBLE) / 1000000.0 END)")


def round_sql(expr: str, digits: int) -> str:
    """DuckDB rounding that matches Spark's ``round`` on doubles: half-up on the
    shortest decimal text of the value."""
    return (f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)")
