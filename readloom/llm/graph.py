"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import stash, unstash


def _lowest(edges: DataFrame) -> DataFrame:
    """Directed edges (u, v) plus low: the smallest of u and all its v."""
    low = edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return edges.join(low, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v): component is the smallest reachable node.

    Each step works on whole edges in shuffles, with sums per node combined before
    them, and is written to the shared folder; nothing gathers at the driver. Self
    loops and repeated edges are allowed; nodes without an edge to another do not appear.
    """
    now = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.distinct()
        # In large every v is below its u: the small star hangs u and its v's on the smallest v.
        small = _lowest(large)
        small = small.select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        after = stash(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        unstash(now)
        now = after
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
