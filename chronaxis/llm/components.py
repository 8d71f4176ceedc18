"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every id that has an edge: id, label.

    ``edges`` holds a, b.  Each round points every node at the smallest label
    among its neighbours and then follows that pointer once more, so distances
    shrink geometrically on stars and paths alike.  Rounds are written out, so
    lineage stays short; only one count per round reaches the driver.
    """
    edges = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tree = persisted(edges, "edges")
    pointers = None
    while True:
        both = tree.select("a", "b").unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        # Larger neighbours move to the smallest one; the node itself follows.
        moved = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("_m").alias("a"), "b")
        kept = least.filter(F.col("_m") < F.col("a")).select(F.col("_m").alias("a"), F.col("a").alias("b"))
        large = moved.unionByName(kept).filter(F.col("a") != F.col("b")).distinct()
        # Smaller neighbours of a node meet at the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("_m"))
        small = large.join(low, "b").select(F.col("_m").alias("_to"), "a", "b")
        after = small.select(F.col("_to").alias("a"), "b").unionByName(small.select(F.col("_to").alias("a"), F.col("a").alias("b")))
        after = persisted(after.filter(F.col("a") != F.col("b")).distinct(), "edges")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == pointers:
            break
        tree, pointers = after, now
    nodes = tree.select(F.col("b").alias("id"), F.col("a").alias("label"))
    return nodes.unionByName(tree.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct())
