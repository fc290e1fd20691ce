"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each round is a minimum per node and a join, both of which Spark combines before the shuffle or splits where a key is
hot. Rounds are written to the shared folder, so a lost executor costs one round at most. No links leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoraspark.llm.common import stored

MAX_ROUNDS = 60


def _star(pairs: DataFrame) -> DataFrame:
    """From (u, v) with u >= v in both steps' sense: link every v to the least neighbour of its u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns a and b (long). Returns node, root for every node of a link; root is the least node reachable.

    Self-links and repeated links do no harm; an empty table gives an empty table.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = stored(edges, "links")
    nodes = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    seen = None
    for _ in range(MAX_ROUNDS):
        # large star: of a node's neighbours, those larger than it are linked to the least of all, itself included
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("p")).select("p.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: of a node's smaller neighbours, all and the node itself are linked to the least
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges = stored(small, "links")
        n, state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if (n, state) == seen:
            break
        seen = (n, state)
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
