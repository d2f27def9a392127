"""Connected components of a table of links, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.scratch import dropped, saved

MAX_ROUNDS = 50


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Rows of (id, component: the least id reachable) for all ids in edges.

    Each round hangs every neighbour of a node, and the node itself, on the least of them: the larger ones first, then the
    smaller ones, so chains shorten by half and more. Rows of a round: at most two for each link. Rounds end when nothing
    moves; should labels still move after MAX_ROUNDS (2**50 nodes in a chain), it raises. Hot nodes keep one partial minimum for each task; their neighbours meet it in a join that can be split.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    last = settled = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Nodes with no larger neighbour keep their own links, so that none is lost.
        large = large.unionByName(now.join(least, "u").select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        step = saved(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        mark = step.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        dropped(now)
        now = step
        settled = mark == last
        if settled:
            break
        last = mark
    if not settled:
        raise RuntimeError(f"labels still move after {MAX_ROUNDS} rounds")
    ids = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return ids.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct().join(ids.select("id"), "id", "left_anti"))
