"""Connected components by alternating large-star and small-star rounds; all state lies in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freed, saved

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """id, label: for each end of an edge (a, b) the smallest id that it reaches."""
    tree = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    for _ in range(ROUNDS):
        both = tree.unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: neighbours above a node go to its least neighbour.
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its neighbours below it go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        new = saved(small, "edges")
        # Done when every edge is a node's only one and leads to a root.
        state = new.agg(F.count("*"), F.countDistinct("a")).first()
        chained = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        freed(tree)
        tree = new
        if state[0] == state[1] and not chained:
            break
    else:
        raise RuntimeError("components did not settle")
    return tree.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(tree.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` as ``components`` gives them, once ``edges`` (a, b) are there too.

    Only the graph of components that the edges link is solved, not all of it
    again.  The last join may meet a label of very many ids, whose rows Spark
    can split.
    """
    own = labels.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    for end in ("a", "b"):
        edges = edges.join(own, F.col(end) == F.col("_id"), "left").withColumn(end, F.coalesce("_label", end)).drop("_id", "_label")
    tops = saved(components(edges), "tops")
    up = tops.select(F.col("id").alias("_low"), F.col("label").alias("_top"))
    known = labels.join(up, F.col("label") == F.col("_low"), "left").select("id", F.coalesce("_top", "label").alias("label"))
    return known.unionByName(tops.join(labels.select("id"), "id", "left_anti"))
