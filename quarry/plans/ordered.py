"""Order-dependent computations that stay parallel when one group is huge.

A plain ``Window.partitionBy(group).orderBy(...)`` sends every row of a group
to one task.  The two plan shapes here split each group across range
partitions instead:

1. ``repartitionByRange(P, group, order...)`` with an explicit ``P``.  The range
   bounds are sampled once; with an explicit partition count AQE does not
   coalesce this exchange, so ``spark_partition_id()`` read right after it is a
   stable, order-preserving slice number.
2. A local window per ``(slice, group)``.  Its size is bounded by one range
   partition, whatever the skew of ``group``.
3. A per-slice boundary table (at most ``P + #groups`` rows, a bound set by
   configuration and by the number of groups, never by the row count) that is
   broadcast back to stitch the slices together.

The slice-tagged rows are consumed twice (rows and boundary table); they are
checkpointed once (``spark.checkpoint.dir``) so both consumers see the same
slice numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir, shuffle_partitions

_PID = "__slice"


def join_on(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` where NULL matches NULL (group keys may be NULL),
    keeping the left side's key columns.  Spark plans ``<=>`` keys as
    ordinary hash / sort-merge / broadcast join keys."""
    if not cols:
        raise ValueError("join_on needs at least one column")
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in cols else F.col(c)
                             for c in right.columns])
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(renamed[f"__r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in cols])


SLICE_BYTES = 64 << 20


def slice_count(df: DataFrame) -> int:
    """Number of range slices: one per 64 MB of the inputs' bytes, without an
    upper cap, and at least the number of cores.  The inputs are the plan's
    leaves (a join's own estimate is the product of its sides)."""
    spark = df.sparkSession
    try:
        cores = spark.sparkContext.defaultParallelism
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except Exception:  # no JVM-side plan access: use the configured count
        return shuffle_partitions(spark)
    if any(s >= 1 << 60 for s in sizes):  # a leaf of unknown size
        return max(cores, shuffle_partitions(spark))
    return max(cores, -(-sum(sizes) // SLICE_BYTES))


def _ranged(df: DataFrame, group_cols: list[str], order_cols: list[str],
            parts: int | None) -> DataFrame:
    """Range-partition and tag every row with its slice number, then cut the
    lineage with a reliable checkpoint.

    The range bounds come from sampling.  Two consumers of the tagged rows
    that Spark planned as two separate exchanges (for example after different
    column pruning) would each sample again and could disagree on slice
    numbers; reading one checkpointed copy makes the numbering a stored fact,
    which also holds when executors are lost and tasks are re-run.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = parts or slice_count(df)
    return (df.repartitionByRange(n, *group_cols, *order_cols)
              .withColumn(_PID, F.spark_partition_id())
              .checkpoint(eager=True))


SLICE = _PID


def range_slices(df: DataFrame, group_cols: list[str], order_cols: list[str],
                 parts: int | None = None) -> DataFrame:
    """Rows tagged with a stable slice number (column ``SLICE``), range
    partitioned by ``group_cols + order_cols`` and checkpointed.  Any subset
    of the rows can then be handed to :func:`prefix_sum` with
    ``presliced=True`` for a prefix in (a prefix of) that order."""
    return _ranged(df, group_cols, order_cols, parts)


def prefix_sum(df: DataFrame, group_cols: list[str], order_cols: list[str],
               weight: str, out: str = "cum_before", parts: int | None = None,
               broadcast_offsets: bool = False, presliced: bool = False) -> DataFrame:
    """Add ``out`` = sum of ``weight`` over the rows before each row of its group.

    Rows must be totally ordered within a group by ``order_cols`` (ties get an
    arbitrary but consistent order).  Exclusive prefix: the first row gets 0.
    ``presliced``: ``df`` already carries slice numbers from
    :func:`range_slices` over an ordering that starts with these columns.
    """
    ranged = df if presliced else _ranged(df, group_cols, order_cols, parts)
    local_w = (Window.partitionBy(_PID, *group_cols).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, -1))
    whole_w = Window.partitionBy(_PID, *group_cols)
    local = (ranged
             .withColumn("__local", F.coalesce(F.sum(weight).over(local_w), F.lit(0)))
             .withColumn("__slice_total", F.sum(weight).over(whole_w)))
    # One row per (slice, group): at most P + #groups rows in total because a
    # group occupies a contiguous run of slices.
    totals = local.groupBy(_PID, *group_cols).agg(F.max("__slice_total").alias("__t"))
    off_w = (Window.partitionBy(*group_cols).orderBy(_PID)
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(_PID, *group_cols,
                            F.coalesce(F.sum("__t").over(off_w), F.lit(0)).alias("__off"))
    # offsets has at most P + #groups rows: a forced broadcast only where the
    # caller knows that the number of groups is bounded.
    off_side = F.broadcast(offsets) if broadcast_offsets else offsets
    return (join_on(local, off_side, [_PID, *group_cols], "inner")
                 .withColumn(out, F.col("__off") + F.col("__local"))
                 .drop("__off", "__local", "__slice_total", _PID))


def lag_in_group(df: DataFrame, group_cols: list[str], order_cols: list[str],
                 value_cols: list[str], prefix: str = "prev_",
                 parts: int | None = None) -> DataFrame:
    """Add ``prefix + c`` = value of ``c`` on the previous row of the group.

    Equivalent to ``lag(c).over(partitionBy(group).orderBy(order))`` but a hot
    group is spread over many tasks.
    """
    ranged = _ranged(df, group_cols, order_cols, parts)
    w = Window.partitionBy(_PID, *group_cols).orderBy(*order_cols)
    local = ranged.withColumn("__rn", F.row_number().over(w))
    for c in value_cols:
        local = local.withColumn(prefix + c, F.lag(c).over(w))
    # Last row of every non-empty slice (P rows at most).
    order_struct = F.struct(*[F.col(c) for c in group_cols], *[F.col(c) for c in order_cols])
    payload = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group_cols)],
                       *[F.col(c).alias(f"v{i}") for i, c in enumerate(value_cols)])
    last = local.groupBy(_PID).agg(F.max_by(payload, order_struct).alias("__last"))
    # The boundary a slice inherits is the last row of the nearest earlier
    # non-empty slice; a window without partitionBy is fine on <= P rows.
    prev_last = last.select(_PID, F.lag("__last").over(Window.orderBy(_PID)).alias("__pl"))
    joined = local.join(F.broadcast(prev_last), _PID, "left")
    same_group = F.lit(True)
    for i, c in enumerate(group_cols):
        same_group = same_group & F.col(f"__pl.g{i}").eqNullSafe(F.col(c))
    take = (F.col("__rn") == 1) & F.col("__pl").isNotNull() & same_group
    for i, c in enumerate(value_cols):
        joined = joined.withColumn(prefix + c, F.when(take, F.col(f"__pl.v{i}"))
                                   .otherwise(F.col(prefix + c)))
    return joined.drop("__rn", "__pl", _PID)


def row_index_in_group(df: DataFrame, group_cols: list[str], order_cols: list[str],
                       out: str = "rn", parts: int | None = None) -> DataFrame:
    """1-based position of each row within its group (``row_number``), skew-safe."""
    with_one = df.withColumn("__one", F.lit(1).cast("long"))
    return (prefix_sum(with_one, group_cols, order_cols, "__one", out="__cb", parts=parts)
            .withColumn(out, F.col("__cb") + 1).drop("__cb", "__one"))

