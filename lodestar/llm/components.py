"""Connected components of a graph that is an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node with an edge to another; the label is the smallest node that it reaches.

    edges: (u, v) of one orderable type; order, repeats and loops don't matter.
    Large-star and small-star steps alternate until the edges are stars: each is
    one aggregation (pre-aggregated before its shuffle) and one join, so a node
    with very many neighbours is split like any skewed key.  Each round is
    checkpointed, which cuts the lineage and survives lost executors.
    """
    step = F.col("u") != F.col("v")
    now = checkpointed(edges.where(step).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("label"))
            ).distinct()
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(step).distinct()
        # every edge is now (larger, smaller): the small star of a node is over its smaller neighbours
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(step)
        now = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
