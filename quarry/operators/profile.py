"""Column profiles of any DataFrame.

Plan shape of :func:`profile_table` (``exact=True``) - one pass over the rows:

* the value-count table ``vc(keys, cidx, l, d, s, cnt)``: every cell is
  exploded to (column index, typed value) and counted with
  ``groupBy().count()``; map-side partial aggregation collapses hot values
  before the shuffle, NULL cells form one group per column.  It is
  range-partitioned by (group, column, value), tagged with slice numbers and
  checkpointed once;
* one aggregate over ``vc`` per (group, column): row and null counts,
  distinct count, mode, min, max and the exact mean;
* a second pass over ``vc`` for the central moments (std, skewness, kurtosis);
* exact quantiles from ranks: counts per slice first, then running sums inside
  the slices that hold a target rank, so no task ever holds a whole column and
  the value counts are not moved again.

``exact=False`` is the sketch path (:mod:`quarry.operators.sketches`): one wide
aggregate over the rows with HLL and KLL sketches and power sums, plus value
counts of the categorical columns only (their mode).
Several ``count_distinct`` in one ``agg`` are avoided on both paths (they
would expand every row once per column).
"""

from __future__ import annotations

import functools
import inspect
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.clean import (ColumnSpec, bool_text, column_specs, is_metric_name,
                                    normalized)
from quarry.functions.numeric import exact_mean, exact_units, mean_from_parts, mean_parts, unit_mean
from quarry.functions.text import float_text
from quarry.plans.ordered import SLICE, join_on, range_slices
from quarry.sources.readers import file_order
from quarry.sources.sinks import new_location

QUANTILES = [("q1", 0.25), ("median", 0.5), ("q3", 0.75)]

PROFILE_COLUMNS = ["column", "ordinal", "dtype", "row_count", "null_count", "null_pct",
                   "unique_count", "mean", "std", "min", "max", "median", "q1", "q3",
                   "skewness", "kurtosis", "mode"]


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _private_keys(fn):
    """Run ``fn`` with its group ``keys`` renamed to private names (so a key
    may be called like an internal column: cidx, l, d, s, cnt, ...) and give
    the keys their names back on the output."""
    sig = inspect.signature(fn)

    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        bound = sig.bind(*args, **kwargs)
        bound.apply_defaults()
        keys = list(bound.arguments.get("keys") or [])
        private = [f"__key{i}" for i in range(len(keys))]
        if not keys or keys == private:
            return fn(*bound.args, **bound.kwargs)
        bound.arguments["df"] = bound.arguments["df"].withColumnsRenamed(dict(zip(keys, private)))
        bound.arguments["keys"] = private
        out = fn(*bound.args, **bound.kwargs)

        def back(d):
            return d.withColumnsRenamed(dict(zip(private, keys)))
        return tuple(back(o) for o in out) if isinstance(out, tuple) else back(out)
    return wrapper


def _by_ordinal(specs: list[ColumnSpec], attr: str) -> Column:
    """Per-row lookup of a column's name/dtype from its ordinal ``cidx``: a
    literal array indexed in the expression, no join and no driver table."""
    values = F.array(*[F.lit(getattr(s, attr)) for s in sorted(specs, key=lambda x: x.ordinal)])
    return F.element_at(values, F.col("cidx") + 1)


def _data_specs(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[ColumnSpec]]:
    """Normalise values and classify the non-key columns."""
    norm = normalized(df)
    specs = [s for s in column_specs(df) if s.name not in keys]
    # Ordinals are positions among the profiled columns.
    specs = [ColumnSpec(s.name, i, s.dtype, s.kind) for i, s in enumerate(specs)]
    return norm, specs


# --------------------------------------------------------------------------
# pass B: value counts
# --------------------------------------------------------------------------

def _cell(s: ColumnSpec) -> Column:
    """Typed slot of one cell: integral/bool -> l, fractional -> d, else s.

    A decimal has its value in d and its exact text in s, so that distinct
    values beyond double precision stay distinct."""
    c = _q(s.name)
    null_l = F.lit(None).cast("long")
    null_d = F.lit(None).cast("double")
    null_s = F.lit(None).cast("string")
    if s.kind == "integral":
        parts = (c.cast("long"), null_d, null_s)
    elif s.kind == "bool":
        parts = (c.cast("int").cast("long"), null_d, null_s)
    elif s.kind == "fractional":
        parts = (null_l, c.cast("double"), c.cast("string") if s.dtype.startswith("decimal") else null_s)
    else:
        parts = (null_l, null_d, c.cast("string"))
    return F.struct(F.lit(s.ordinal).alias("cidx"), parts[0].alias("l"),
                    parts[1].alias("d"), parts[2].alias("s"))


def value_counts(norm: DataFrame, specs: list[ColumnSpec], keys: list[str],
                 include_nulls: bool = False) -> DataFrame:
    """(keys, cidx, l, d, s, cnt) for every value of every column.

    With ``include_nulls`` the NULL cells of a column form one more group
    (l, d and s all NULL), which gives row and null counts from the same pass.
    """
    if not specs:
        schema = ", ".join([f"`{k}` string" for k in keys] +
                           ["cidx int", "l bigint", "d double", "s string", "cnt bigint"])
        return norm.sparkSession.createDataFrame([], schema)
    cells = (norm.select(*[_q(k) for k in keys],
                         F.explode(F.array(*[_cell(s) for s in specs])).alias("c"))
                 .select(*keys, "c.*"))
    if not include_nulls:
        cells = cells.where(_not_null_cell())
    return (cells.groupBy(*keys, "cidx", "l", "d", "s")
                 .agg(F.count(F.lit(1)).alias("cnt")))


def _not_null_cell() -> Column:
    return F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull()


def _value_text(specs: list[ColumnSpec]) -> Column:
    bools = [s.ordinal for s in specs if s.kind == "bool"]
    as_bool = bool_text(F.col("l") == 1)
    txt = F.coalesce(F.col("s"), F.col("l").cast("string"), float_text(F.col("d")))
    if bools:
        txt = F.when(F.col("cidx").isin(bools), as_bool).otherwise(txt)
    return txt


def _value_num() -> Column:
    return F.coalesce(F.col("d"), F.col("l").cast("double"))


def _column_stats(vc_all: DataFrame, specs: list[ColumnSpec], keys: list[str]) -> DataFrame:
    """One aggregation over the value counts (NULL cells included) per
    (group, column): row and non-null counts, distinct count, mode, and for
    numeric columns min, max and the mean.

    Mean: exact decimal sum of value x count (see ``functions.numeric``),
    rounded half-up at 6 digits; one rule at every size.  ``mu`` is the
    full-precision floating mean used to centre the moments (the decimal
    quotient carries 6 digits only).
    """
    numeric = [s.ordinal for s in specs if s.numeric]
    nn = _not_null_cell()
    isnum = F.col("cidx").isin(numeric) if numeric else F.lit(False)
    v = F.when(nn & isnum, _value_num())
    w = F.col("cnt").cast("double")
    order_key = F.when(nn, F.struct((-F.col("cnt")).alias("nc"), v.alias("v"),
                                    F.col("s").alias("s"), F.col("l").alias("l")))
    d = F.when(isnum, F.col("d"))
    times = F.col("cnt").cast("decimal(13,0)")
    whole = F.when(nn & isnum & d.isNull(), exact_units(F.col("l"), True))
    real = F.when(nn & isnum, exact_units(d))
    stats = vc_all.groupBy(*keys, "cidx").agg(
        F.sum("cnt").alias("row_count"),
        F.sum(F.when(nn, F.col("cnt")).otherwise(F.lit(0))).alias("n"),
        F.count(F.when(nn, F.lit(1))).alias("unique_count"),
        F.min_by(F.when(nn, _value_text(specs)), order_key).alias("mode"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.sum(w * v).alias("fsum"),
        F.try_sum(F.try_multiply(whole, times)).alias("wsum"), F.try_sum(F.try_multiply(real, times)).alias("rsum"),
        F.count(whole).alias("wholes"), F.count(real).alias("reals"), F.count(v).alias("nvals"))
    # a column holds whole numbers or reals, never both
    dmean = (F.when(F.col("wholes") == F.col("nvals"), unit_mean(F.col("wsum"), F.col("n"), True))
              .when(F.col("reals") == F.col("nvals"), unit_mean(F.col("rsum"), F.col("n"))))
    fmean = F.col("fsum") / F.col("n").cast("double")
    return stats.select(
        *keys, "cidx", "row_count", "n", "unique_count", "mode", "min", "max",
        F.when(F.col("nvals") > 0, F.coalesce(F.round(dmean, 6).cast("double"), F.round(fmean, 6))).alias("mean"),
        F.when(F.col("nvals") > 0, fmean).alias("mu"))


def _central_moments(vc: DataFrame, stats: DataFrame, specs: list[ColumnSpec],
                     keys: list[str], small: bool = True) -> DataFrame:
    """(keys, cidx, std, skew, kurt): second pass over the value counts.

    Deviations from ``mu`` summed with the counts as weights (m2 with the
    usual correction term).  Formulas are Spark's: sample std, population
    skewness sqrt(n)*m3/m2^1.5 and excess kurtosis n*m4/m2^2 - 3 (NULL when
    m2 = 0).
    """
    numeric = [s.ordinal for s in specs if s.numeric]
    grp = [*keys, "cidx"]
    mu = stats.where(F.col("mu").isNotNull()).select(*grp, "mu", "n")
    # One row per (group, column); broadcast when its checked size is small.
    mu_side = F.broadcast(mu) if small else mu
    dev = _value_num() - F.col("mu")
    w = F.col("cnt").cast("double")
    s2 = (join_on(vc.where(F.col("cidx").isin(numeric)), mu_side, grp, "inner")
            .groupBy(*grp).agg(F.max("n").alias("n"), F.sum(w * dev).alias("c1"),
                               F.sum(w * dev * dev).alias("c2"),
                               F.sum(w * dev * dev * dev).alias("c3"),
                               F.sum(w * dev * dev * dev * dev).alias("c4")))
    n = F.col("n").cast("double")
    m2 = F.col("c2") - F.col("c1") * F.col("c1") / n
    return s2.select(
        *grp,
        F.when(F.col("n") > 1, F.sqrt(m2 / (n - 1))).alias("std"),
        F.when(m2 > 0, F.sqrt(n) * F.col("c3") / F.sqrt(m2 * m2 * m2)).alias("skew"),
        F.when(m2 > 0, n * F.col("c4") / (m2 * m2) - 3.0).alias("kurt"))


def _exact_quantiles(vc: DataFrame, stats: DataFrame, specs: list[ColumnSpec],
                     keys: list[str], small: bool = True, quantiles: list[tuple[str, float]] = QUANTILES) -> DataFrame:
    """(keys, cidx, <name>_lo, <name>_hi): of each quantile the values at ranks
    floor((n-1)q) and ceil((n-1)q), to be interpolated between.

    Two steps, so that the value counts are not moved once more: counts per
    (slice, column) tell which slices hold the target ranks of a column;
    only the rows of those slices are ranked by a local running sum.
    """
    numeric = [s.ordinal for s in specs if s.numeric]
    grp = [*keys, "cidx"]
    nv = (vc.where(F.col("cidx").isin(numeric))
            .select(*keys, "cidx", F.col("__v").alias("v"), "cnt", SLICE))
    ends = []
    for name, q in quantiles:
        pos = (F.col("n") - 1).cast("double") * F.lit(q)
        ends.append(F.struct(F.lit(f"{name}_lo").alias("e"), F.floor(pos).cast("long").alias("r")))
        ends.append(F.struct(F.lit(f"{name}_hi").alias("e"), F.ceil(pos).cast("long").alias("r")))
    targets = (stats.where(F.col("cidx").isin(numeric) & (F.col("n") > 0))
                    .select(*grp, F.explode(F.array(*ends)).alias("t"))
                    .select(*grp, "t.e", "t.r"))
    earlier = Window.partitionBy(*grp).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    held = (nv.groupBy(*grp, SLICE).agg(F.sum("cnt").alias("inside"))
              .withColumn("before", F.coalesce(F.sum("inside").over(earlier), F.lit(0).cast("long"))))
    # at most two rows per (group, column) and quantile
    places = (join_on(held, targets, grp).where((F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("inside")))
              .select(*grp, SLICE, "before", "e", "r").checkpoint(eager=True))

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df
    part = join_on(nv, side(places.select(*grp, SLICE, "before").distinct()), [*grp, SLICE])
    local = Window.partitionBy(*grp, SLICE).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = part.withColumn("cb", F.col("before") + F.coalesce(F.sum("cnt").over(local), F.lit(0).cast("long"))).drop("before")
    hit = (join_on(ranked, side(places.drop("before")), [*grp, SLICE])
           .where((F.col("r") >= F.col("cb")) & (F.col("r") < F.col("cb") + F.col("cnt"))))
    names = [f"{n}_{end}" for n, _ in quantiles for end in ("lo", "hi")]
    return hit.groupBy(*grp).agg(*[F.max(F.when(F.col("e") == e, F.col("v"))).alias(e) for e in names])


def _interpolated(name: str, q: float) -> Column:
    pos = (F.col("n") - 1).cast("double") * F.lit(q)
    frac = pos - F.floor(pos)
    lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
    return lo + frac * (hi - lo)


def _vc_summary(vc: DataFrame, specs: list[ColumnSpec], keys: list[str]) -> DataFrame:
    """(keys, cidx, unique_count, mode) from the value counts."""
    numeric = [s.ordinal for s in specs if s.numeric]
    order_key = F.struct((-F.col("cnt")).alias("nc"),
                         F.when(F.col("cidx").isin(numeric), _value_num()).alias("v"),
                         F.col("s").alias("s"), F.col("l").alias("l"))
    return (vc.withColumn("txt", _value_text(specs))
              .groupBy(*keys, "cidx")
              .agg(F.count(F.lit(1)).alias("unique_count"),
                   F.min_by("txt", order_key).alias("mode")))


def profile_table(df: DataFrame, keys: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Long-form profile: one row per (group,) column with the scalar statistics.

    Columns: ``PROFILE_COLUMNS`` (plus the group keys first).  Doubles are
    rounded the way the reference rounds them (6 digits, skew/kurtosis 4,
    null_pct 2).
    """
    return profile_tables(df, keys, exact)[0]


@_private_keys
def profile_tables(df: DataFrame, keys: list[str] | None = None, exact: bool = True,
                   bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """(profile, histogram) of ``df``.  With ``exact=True`` the histograms come
    from the same checkpointed value counts as the profile (no second pass
    over the rows)."""
    keys = list(keys or [])
    norm, specs = _data_specs(df, keys)
    if exact:
        prof, hist, _ = profile_of_counts(value_counts(norm, specs, keys, include_nulls=True), specs, keys, bins)
        return prof, hist
    from quarry.operators.sketches import profile_of_sketches, sketch_rows

    rows = profile_of_sketches(sketch_rows(df, keys), keys)
    modes = (_vc_summary(value_counts(norm, [s for s in specs if s.categorical], keys), specs, keys)
             .select(*keys, F.col("cidx").alias("ordinal"), "mode"))
    return join_on(rows, modes, [*keys, "ordinal"], "left").select(*keys, *PROFILE_COLUMNS), histogram(df, bins, keys)


def profile_with_quantiles(df: DataFrame, quantiles: list[tuple[str, float]]) -> tuple[DataFrame, DataFrame]:
    """(:func:`profile_table`, (column, <name>...)): the profile, and further exact quantiles of the
    numeric columns from the same value counts, by distributed ranks."""
    norm, specs = _data_specs(df, [])
    prof, _, _, found = profile_of_counts(value_counts(norm, specs, [], include_nulls=True), specs, quantiles=quantiles)
    return prof, found


def profile_of_counts(counts: DataFrame, specs: list[ColumnSpec], keys: list[str] | None = None, bins: int = 10,
                      k: int = 5, quantiles: list[tuple[str, float]] | None = None) -> tuple[DataFrame, ...]:
    """(profile, histogram, top values) from value counts ``(keys, cidx, l, d, s, cnt)``; with
    ``quantiles`` (names and fractions) also (keys, column, <name>...).

    The counts are a mergeable state: those of several files or versions are
    added up per value, and give the exact profile of the whole without the
    rows.  They are materialised once with a reliable checkpoint and feed every
    statistic; without it each consumer would re-run what made them (the
    consumers' filters differ, so Spark cannot reuse it).  They are
    range-partitioned by (group, column, value) first: the slices give the
    quantile ranks their order without another shuffle, and text values are
    part of the key so no column lands in one slice.
    """
    keys, spark, grp = list(keys or []), counts.sparkSession, [*(keys or []), "cidx"]
    if not specs:
        empty = [*[f"`{x}` string" for x in keys]]
        none = spark.range(0).select(*[F.lit(None).cast("string").alias(x) for x in keys], F.lit(0).alias("cidx"))
        stats = none.select("*", *[F.lit(None).cast("double").alias(c) for c in
                                   ("mean", "std", "min", "max", "median", "q1", "q3", "skew", "kurt")],
                            *[F.lit(0).cast("long").alias(c) for c in ("row_count", "n", "unique_count")], F.lit("").alias("mode"),
                            F.lit("").alias("column"), F.lit("").alias("dtype"))
        hist = spark.createDataFrame([], ", ".join([*empty, _EMPTY_HIST]))
        nothing = _named(stats, keys), hist, spark.createDataFrame([], ", ".join([*empty, "column string, rank int, value string, n bigint"]))
        return nothing if quantiles is None else (*nothing, spark.createDataFrame([], ", ".join([*empty, "column string", *[f"`{n}` double" for n, _ in quantiles]])))
    numeric = [s.ordinal for s in specs if s.numeric]
    vc_all = counts.withColumn("__v", F.when(F.col("cidx").isin(numeric), _value_num()) if numeric else F.lit(None).cast("double"))
    vc_all = range_slices(vc_all, grp, ["__v", "s", "l"])
    vc = vc_all.where(_not_null_cell())
    # The per-(group, column) stats feed three consumers; checkpointed once.
    stats = _column_stats(vc_all, specs, keys).checkpoint(eager=True)
    # Without group keys these tables have one row per column of the schema
    # and are broadcast; with keys they grow with the data and are left to AQE.
    small = not keys
    quant = _exact_quantiles(vc, stats, specs, keys, small)
    cm = _central_moments(vc, stats, specs, keys, small)
    if small:
        quant, cm = F.broadcast(quant), F.broadcast(cm)
    out = (join_on(join_on(stats, quant, grp, "left"), cm, grp, "left")
           .select("*", *[_interpolated(n, q).alias(n) for n, q in QUANTILES]))
    hs = [s for s in specs if s.histogram]
    hist = (_histogram_of(vc.where(F.col("cidx").isin([s.ordinal for s in hs]))
                            .select(*keys, "cidx", _value_num().alias("v"), F.col("cnt").alias("w")), specs, keys, bins, spark)
            if hs else spark.createDataFrame([], ", ".join([*[f"`{x}` string" for x in keys], _EMPTY_HIST])))
    found = (_profile_rows(out, specs, keys), hist, _top_of_counts(vc, specs, keys, k))
    if quantiles is None:
        return found
    ends = join_on(stats, _exact_quantiles(vc, stats, specs, keys, small, quantiles), grp, "inner")
    return *found, ends.select(*keys, _by_ordinal(specs, "name").alias("column"), *[_interpolated(n, q).alias(n) for n, q in quantiles])


def _profile_rows(out: DataFrame, specs: list[ColumnSpec], keys: list[str]) -> DataFrame:
    """Per-(group, column) statistics in their final form and order."""
    name, dtype = _by_ordinal(specs, "name"), _by_ordinal(specs, "dtype")
    if keys:
        return _named(out.select("*", name.alias("column"), dtype.alias("dtype")), keys)
    # Every column gets a row, also when the table is empty.
    meta = (out.sparkSession.range(len(specs)).select(F.col("id").cast("int").alias("cidx"))
            .select("cidx", name.alias("column"), dtype.alias("dtype")))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("row_count", "n", "unique_count")}
    return _named(F.broadcast(meta).join(out, "cidx", "left").withColumns(zero), keys)


def _named(out: DataFrame, keys: list[str]) -> DataFrame:
    nulls = F.col("row_count") - F.col("n")
    r6 = lambda c: F.round(F.col(c), 6)
    r4 = lambda c: F.round(F.col(c), 4)
    return out.select(
        *keys,
        F.col("column"), F.col("cidx").alias("ordinal"), F.col("dtype"),
        F.col("row_count"), nulls.alias("null_count"),
        F.round(F.try_divide(nulls, F.col("row_count")) * 100, 2).alias("null_pct"),
        F.col("unique_count").cast("long").alias("unique_count"),
        r6("mean").alias("mean"), r6("std").alias("std"), r6("min").alias("min"),
        r6("max").alias("max"), r6("median").alias("median"), r6("q1").alias("q1"),
        r6("q3").alias("q3"), r4("skew").alias("skewness"), r4("kurt").alias("kurtosis"),
        F.col("mode"))


def light_profile(df: DataFrame) -> DataFrame:
    """(column, ordinal, dtype, row_count, null_count, null_pct, mean, min, max, mode): what reports read.

    One wide aggregate over the scan (exact means, no distinct counts, no
    quantiles), and value counts of the categorical columns only, for their
    mode.  Values equal those of :func:`profile_table`; the mode of other
    columns is left out.
    """
    norm, specs = _data_specs(df, [])
    rows = F.count(F.lit(1))
    parts = []
    for s in specs:
        c = _q(s.name)
        numbers = [F.lit(None).cast("double")] * 3
        if s.numeric:
            integral = s.kind == "integral"
            numbers = [exact_mean(c.cast("long") if integral else c.cast("double"), integral), F.min(c.cast("double")), F.max(c.cast("double"))]
        parts.append(F.struct(
            F.lit(s.name).alias("column"), F.lit(s.ordinal).alias("ordinal"), F.lit(s.dtype).alias("dtype"), rows.alias("row_count"),
            (rows - F.count(c)).alias("null_count"), F.round(F.try_divide(rows - F.count(c), rows) * 100, 2).alias("null_pct"),
            *[F.round(x, 6).alias(n) for x, n in zip(numbers, ("mean", "min", "max"))]))
    wide = norm.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    cats = [s for s in specs if s.categorical]
    modes = _vc_summary(value_counts(norm, cats, []), specs, []).select(F.col("cidx").alias("ordinal"), "mode")
    return wide.join(F.broadcast(modes), "ordinal", "left").select("column", "ordinal", "dtype", "row_count", "null_count", "null_pct", "mean", "min", "max", "mode")


def column_presence(df: DataFrame) -> DataFrame:
    """(column, n): every column of a dataset with its non-null count - one
    aggregate over the rows, enough for schema comparisons (U1-U3)."""
    cols = [F.struct(F.lit(c).alias("column"), F.count(_q(c)).alias("n")) for c in df.columns]
    return df.agg(F.array(*cols).alias("a")).select(F.inline("a"))


def profile_by_group(df: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """:func:`profile_table` per value of ``keys``."""
    return profile_table(df, keys=keys, exact=exact)


# --------------------------------------------------------------------------
# top values, mode, histogram, duplicates, metrics
# --------------------------------------------------------------------------

@_private_keys
def top_values(df: DataFrame, k: int = 5, keys: list[str] | None = None) -> DataFrame:
    """(column, rank, value, n): the k most frequent values of categorical columns.

    Ties are broken by value.  ``row_number() <= k`` lets Spark put a partial
    per-group limit in front of the shuffle (WindowGroupLimit), so each task
    sends at most k rows per column.
    """
    keys = list(keys or [])
    norm, specs = _data_specs(df, keys)
    cats = [s for s in specs if s.categorical]
    return _top_of_counts(value_counts(norm, cats, keys), specs, keys, k)


def _top_of_counts(counts: DataFrame, specs: list[ColumnSpec], keys: list[str], k: int) -> DataFrame:
    cats = [s.ordinal for s in specs if s.categorical]
    vc = counts.where(F.col("cidx").isin(cats)).withColumn("value", _value_text(specs))
    w = Window.partitionBy(*keys, "cidx").orderBy(F.col("cnt").desc(), F.col("value"))
    top = vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return (top.withColumn("column", _by_ordinal(specs, "name"))
               .select(*keys, "column", F.col("rank").cast("int").alias("rank"),
                       "value", F.col("cnt").alias("n")))


@_private_keys
def mode(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(column, mode, mode_count): most frequent non-null value, smallest on ties."""
    keys = list(keys or [])
    norm, specs = _data_specs(df, keys)
    vc = value_counts(norm, specs, keys)
    numeric = [s.ordinal for s in specs if s.numeric]
    order_key = F.struct((-F.col("cnt")).alias("nc"),
                         F.when(F.col("cidx").isin(numeric), _value_num()).alias("v"),
                         F.col("s").alias("s"), F.col("l").alias("l"))
    res = (vc.withColumn("txt", _value_text(specs))
             .groupBy(*keys, "cidx")
             .agg(F.min_by("txt", order_key).alias("mode"), F.max("cnt").alias("mode_count")))
    return (res.withColumn("column", _by_ordinal(specs, "name"))
               .select(*keys, "column", "mode", "mode_count"))


def _histogram_of(cells: DataFrame, specs: list[ColumnSpec], keys: list[str], bins: int,
                  spark) -> DataFrame:
    """Histograms from weighted cells ``(keys, cidx, v, w)``: rows with w = 1,
    or value counts with w = cnt (then no pass over the rows is needed).
    ``specs`` is the full column list (names are looked up by ordinal)."""
    grp = [*keys, "cidx"]
    rng = (cells.groupBy(*grp)
                .agg(F.min("v").alias("mn0"), F.max("v").alias("mx0"), F.sum("w").alias("nv"))
                .where(F.col("nv") >= 2)
                .withColumn("mn", F.when(F.col("mn0") == F.col("mx0"), F.col("mn0") - 0.5)
                            .otherwise(F.col("mn0")))
                .withColumn("mx", F.when(F.col("mn0") == F.col("mx0"), F.col("mx0") + 0.5)
                            .otherwise(F.col("mx0")))
                .withColumn("step", (F.col("mx") - F.col("mn")) / F.lit(float(bins)))
                .select(*grp, "mn", "mx", "step"))
    edge = lambda i: F.lit(float(i)) * F.col("step") + F.col("mn")
    bin_expr = reduce(lambda a, b: a + b,
                      [F.when(F.col("v") >= edge(i), 1).otherwise(0) for i in range(1, bins)])
    # rng has one row per (group, column); without keys that is bounded by the
    # schema width and is broadcast, with keys AQE decides from its size.
    rng_side = F.broadcast(rng) if not keys else rng
    counts = (join_on(cells, rng_side, grp)
                   .withColumn("bin", bin_expr)
                   .groupBy(*grp, "bin")
                   .agg(F.sum("w").alias("n"), F.first("mn").alias("mn"),
                        F.first("mx").alias("mx"), F.first("step").alias("step")))
    # Empty bins: each column's counts (at most ``bins`` entries) as a map,
    # then every bin index looked up in it - rng is used once, so the rows
    # (or value counts) are not read again for it.
    per_col = counts.groupBy(*grp).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"),
        F.first("mn").alias("mn"), F.first("mx").alias("mx"), F.first("step").alias("step"))
    all_bins = per_col.select(*grp, "m", "mn", "mx", "step",
                              F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lo = F.col("bin").cast("double") * F.col("step") + F.col("mn")
    hi = F.when(F.col("bin") == bins - 1, F.col("mx")).otherwise(
        (F.col("bin") + 1).cast("double") * F.col("step") + F.col("mn"))
    return (all_bins.withColumn("column", _by_ordinal(specs, "name"))
                    .select(*keys, "column", F.col("bin").cast("int").alias("bin"),
                            F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi"),
                            F.coalesce(F.col("m")[F.col("bin")], F.lit(0)).cast("long").alias("n")))


_EMPTY_HIST = "column string, bin int, lo double, hi double, n bigint"


@_private_keys
def histogram(df: DataFrame, bins: int = 10, keys: list[str] | None = None) -> DataFrame:
    """(column, bin, lo, hi, n): equal-width bins, last bin closed.

    Edges are ``min + i*((max-min)/bins)`` and a value's bin is the number of
    inner edges <= value (edge comparison, so values that sit on an edge land
    where NumPy puts them).  A constant column is widened to [v-0.5, v+0.5];
    columns with fewer than 2 values get no histogram; empty bins are emitted.
    Plan: the per-column (min, max) table (one row per group and column) is
    joined to the exploded numeric cells, the bin counts are partially
    aggregated per task, so the shuffle carries bins x columns rows per task.
    """
    keys = list(keys or [])
    norm, specs = _data_specs(df, keys)
    hs = [s for s in specs if s.histogram]
    if not hs:
        return df.sparkSession.createDataFrame([], _EMPTY_HIST)
    cells = norm.select(*[_q(k) for k in keys], F.explode(F.array(*[
        F.struct(F.lit(s.ordinal).alias("cidx"), _q(s.name).cast("double").alias("v"))
        for s in hs])).alias("c")).select(*keys, "c.*", F.lit(1).cast("long").alias("w")) \
        .where(F.col("v").isNotNull())
    return _histogram_of(cells, specs, keys, bins, df.sparkSession)


def _comparable(c: Column, kind: T.DataType) -> Column:
    """``c`` with every map in it as an array of its entries in key order."""
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_keys(c), lambda k: F.struct(
            _comparable(k, kind.keyType).alias("key"), _comparable(F.element_at(c, k), kind.valueType).alias("value"))))
        return entries
    if isinstance(kind, T.ArrayType) and "map<" in kind.simpleString():
        return F.transform(c, lambda x: _comparable(x, kind.elementType))
    if isinstance(kind, T.StructType) and "map<" in kind.simpleString():
        return F.when(c.isNotNull(), F.struct(*[_comparable(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: number of rows equal to an earlier row (NULLs compare equal).

    Exact, in two phases so that whole rows are only shuffled when they may be
    duplicates:

    1. count rows per 96-bit row hash (``xxhash64`` and ``hash`` of all
       columns); this shuffles 12-byte keys, pre-aggregated per task; the
       candidate hashes, those that occur more than once, are written;
    2. rows with such a hash (semi join; as their size is known by now, Spark
       broadcasts the candidates when they are few and no other row is moved)
       are grouped by the hash *and* every column, which removes any hash
       collision from the count.
    """
    # maps can be neither hashed nor grouped: their entries in key order stand for them
    df = df.select(*[_comparable(_q(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
    cols = [_q(c) for c in df.columns]
    keyed = df.select(F.xxhash64(*cols).alias("__h1"), F.hash(*cols).alias("__h2"), *cols)
    cand = (keyed.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__c"))
                 .where(F.col("__c") > 1).select("__h1", "__h2"))
    where = new_location(df.sparkSession, "duplicate-hashes")
    cand.write.parquet(where)
    cand = df.sparkSession.read.schema(cand.schema).parquet(where)
    groups = (keyed.join(cand, ["__h1", "__h2"], "left_semi")
                   .groupBy("__h1", "__h2", *cols).agg(F.count(F.lit(1)).alias("__c")))
    return groups.agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0).cast("long"))
                      .alias("duplicate_rows"))


def metric_columns(df: DataFrame) -> list[str]:
    """Names of model-metric columns (F10): keyword in the name and numeric
    (booleans count here, as for the reference)."""
    return [s.name for s in column_specs(df)
            if is_metric_name(s.name) and s.kind in ("integral", "fractional", "bool")]


@_private_keys
def custom_metrics(df: DataFrame, order_by: str | list[str] | None = None,
                   keys: list[str] | None = None) -> DataFrame:
    """(metric, latest, max, mean) for every metric column.

    ``latest`` is the value of the last non-null row in ``order_by`` order
    (``max_by``: an aggregate, no sort and no window); without ``order_by``
    the file row order of a Parquet input is used.
    """
    keys = list(keys or [])
    if order_by is None:
        order_cols = file_order(df)
        if order_cols is None:
            raise ValueError("order_by is needed for inputs without a file row order")
    else:
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        order_cols = [_q(o) for o in order]
    names = metric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame(
            [], "metric string, latest double, max double, mean double")
    norm = normalized(df)
    ord_struct = F.struct(*order_cols)
    aggs, fields = [], []
    kinds = {sp.name: sp.kind for sp in column_specs(df)}
    for i, n in enumerate(names):
        x = _q(n).cast("double")
        integral = kinds[n] in ("integral", "bool")
        src = _q(n).cast("long") if integral else x
        aggs += [F.max_by(x, F.when(x.isNotNull(), ord_struct)).alias(f"lt{i}"),
                 F.max(x).alias(f"mx{i}"), exact_mean(src, integral).alias(f"mn{i}"),
                 F.count(x).alias(f"c{i}")]
        fields.append(F.struct(F.lit(n).alias("metric"), F.col(f"lt{i}").alias("latest"),
                               F.col(f"mx{i}").alias("max"), F.col(f"mn{i}").alias("mean"),
                               F.col(f"c{i}").alias("n")))
    g = norm.groupBy(*keys).agg(*aggs) if keys else norm.agg(*aggs)
    return (g.select(*keys, F.inline(F.array(*fields))).where(F.col("n") > 0)
             .select(*keys, "metric", F.round("latest", 6).alias("latest"),
                     F.round("max", 6).alias("max"), F.round("mean", 6).alias("mean")))


def null_ratios(df: DataFrame) -> DataFrame:
    """(column, null_count, null_pct) of every column: one aggregate over the scan (NaN counts as missing)."""
    norm = normalized(df)
    parts = [F.struct(F.lit(c).alias("column"), (F.count(F.lit(1)) - F.count(_q(c))).alias("null_count"),
                      F.round(F.try_divide(F.count(F.lit(1)) - F.count(_q(c)), F.count(F.lit(1))) * 100, 2).alias("null_pct"))
             for c in norm.columns]
    return norm.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def high_null_columns(profile: DataFrame, threshold: float = 5.0) -> DataFrame:
    """profile rows with null_pct > threshold."""
    return profile.where(F.col("null_pct") > threshold)
