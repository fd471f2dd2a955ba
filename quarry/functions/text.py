"""Small text helpers shared by listings and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(ts: Column) -> Column:
    """Timestamp without time zone -> ISO-8601 text the way Python's
    ``isoformat`` prints it (``T`` separator, 6-digit microseconds only when
    not zero).

    Built from the zone-free text cast of the value: ``date_format`` would
    first convert to a session-zone timestamp, which moves wall times that do
    not exist in that zone (daylight-saving gaps).
    """
    text = ts.cast("timestamp_ntz").cast("string")
    with_frac = F.concat(F.substring_index(text, ".", 1), F.lit("."),
                         F.rpad(F.substring_index(text, ".", -1), 6, "0"))
    full = F.when(F.instr(text, ".") > 0, with_frac).otherwise(text)
    return F.regexp_replace(full, " ", "T")


def iso_sql(ts: str) -> str:
    return f"regexp_replace(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"


def capitalize(c: Column) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def fixed2(c: Column) -> Column:
    """Two decimals, half-up on the value's decimal form, as text."""
    return F.format_string("%.2f", F.round(c, 2))


def float_text(c: Column) -> Column:
    """A double as Python prints it: plain from 1e-4 up to 1e16, else with a
    two-digit signed exponent (Java switches to ``E`` at 1e7 and 1e-3)."""
    text = c.cast("string")
    size = F.abs(c.cast("double"))
    plain = F.regexp_replace(c.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    power = F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_extract(text, "^(-?[0-9.]+)E", 1), r"\.0$", "")
    scientific = F.concat(digits, F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                          F.format_string("%02d", F.abs(power)))
    return (F.when(~text.contains("E"), text)
             .when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific))


def thousands(c: Column) -> Column:
    """Integer with ``,`` thousands separators (Python ``{:,}``)."""
    return F.format_number(c.cast("long"), 0)


def to_mb(c: Column, digits: int = 1) -> Column:
    return F.round(c / F.lit(1024.0 * 1024.0), digits)
