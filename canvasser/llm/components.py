"""Connected components of links by alternating large and small stars.

Every round is a few joins and groupings over the links that are left, written to the shared
folder; nothing is collected but two numbers per round. The minimum of a node's neighbours is
combined on the map side, and the join back has the many links of a hub on the side that Spark
may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser.llm.common import saved


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every linked node but the roots; the root is a component's smallest node.

    ``links`` has the columns a and b (long). Null ends and links of a node to itself say nothing.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = saved(edges, "links")
    before = None
    for _ in range(most):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if not state[0] or state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # One row per link; nothing above the join groups rows, so Spark may split the links of a hub.
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large, "large-star")
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(small.unionByName(root.select("a", F.col("m").alias("b"))).distinct(), "small-star")
    raise RuntimeError(f"components did not settle in {most} rounds")
