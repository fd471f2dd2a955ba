"""Connected components by alternating large-star and small-star.

Large-star points every larger neighbour of a node at the smallest node it
knows; small-star points a node's smaller neighbours and the node itself at
their smallest.  The pair is repeated until the edges no longer change; they
then form one star per component, with the smallest node at its centre.  Each
step is a minimum per node (combined before the shuffle), written, and a join
back, whose hot keys adaptive execution can split because both sides are read
from written tables.  Tables are written by as many tasks as the number of
edges asks for, since steps are many and edges often few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, cut_measured, tasks_for

TASK_EDGES = 100_000  # edges that a task stands for


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return int(r[0]), int(r[1] or 0)


def connected_components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; nulls and loops are no links.

    ``tasks`` is the number that the first step writes its edges with; by
    default, that of the shuffle.
    """
    e = (edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
         .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct())
    e = cut_measured(e.coalesce(tasks) if tasks else e)
    before = _mark(e)
    few = tasks_for(edges.sparkSession, before[0] / TASK_EDGES)
    e = e.coalesce(few)
    while before[0]:
        # large-star: (u, v) in both directions; larger neighbours go to the least of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(few))
        large = cut(both.where("v > u").join(least, "u").where("v <> m")
                    .select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few).distinct().coalesce(few))
        # small-star: u > v on every edge
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few))
        joined = large.join(least, "u")
        e = cut_measured(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                         .union(least.select("u", F.col("m").alias("v"))).coalesce(few).distinct().coalesce(few))
        now = _mark(e)
        if now == before:
            break
        before = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(e.select(F.col("v"), F.col("v")).distinct()))
