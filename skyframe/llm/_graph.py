"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm._common import drop_stage, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (u, v) with u > v. Points the larger (or the smaller) neighbours and the node itself at the least one.

    The least neighbour is a combined aggregate and comes back by a join, which Spark splits where a node is a hub.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` of every node that has an edge to another; the root is the least node reachable.

    Every round is written to the shared folder, so plans stay short and a lost executor repeats one round at most.
    """
    current = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    mark = None
    while True:
        step = stage(_star(_star(current, True), False), "edges")
        new = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stage(current)
        current = step
        if new == mark or not new[0]:
            break
        mark = new
    return current.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
