"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditgrove.llm.shared import Scratch

#: Edges of one task of a step: a graph that has become small is not dealt over all shuffle partitions again and again.
TASK_EDGES = 50_000


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of every node that has an edge to another.

    ``edges``: columns ``a`` and ``b`` of one orderable type; nulls and loops are ignored, repeated edges count once.
    Each step writes the edges, so no lineage grows; minima are aggregated before the shuffle, and a node that holds a
    large share of the edges meets only a sort-merge join, which adaptive execution can split.
    """
    now = edges.where("a is not null and b is not null and a <> b")
    now = scratch.keep(now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        tasks = -(-int(state["n"]) // TASK_EDGES)  # coalescing never makes more than there are
        large = scratch.keep(large.coalesce(tasks), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "edges")
        scratch.drop(now, large)
        now = after
