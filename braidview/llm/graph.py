"""Connected components by alternating stars, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


#: Edges in a file of a round, at least: a round is small, and many tiny files cost more than their rows.
EDGES_A_FILE = 200_000


def components(edges: DataFrame) -> DataFrame:
    """``node root`` for every node of the undirected ``edges`` (columns ``a`` and ``b``); a root is its component's smallest node.

    Each round hangs larger neighbours onto the smallest neighbour, then smaller ones onto the smallest of theirs; a component of n nodes
    needs about log n rounds. A round's edges are written to the shared folder, which ends their lineage.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    mark, n = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = now.join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        hung = small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b")))
        after = stored(hung.where("a < b").distinct().coalesce(max(1, n // EDGES_A_FILE)), "edges")  # a round has about as many edges as the one before, or fewer
        n, h = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        drop_stored(now)
        now = after
        if mark == (n, h) or not n:
            break
        mark = (n, h)
    leaves = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return leaves.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
