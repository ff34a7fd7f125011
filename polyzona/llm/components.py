"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregation by node, which combines before the shuffle, and a join of two written tables, whose
skewed partitions Spark can split; so neither a hub with many links nor a long chain gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges(a, b), root being the least node reachable; nodes without links are absent."""
    pairs = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), sweep=False)
    last = None
    for _ in range(rounds):
        # Large star: every neighbour above u is linked to the least of u and its neighbours.
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), sweep=False)
        large = scratch.write(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), sweep=False)
        # Small star: u and its neighbours below it are linked to the least of them.
        low = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), sweep=False)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = scratch.write(small.union(low.select("u", F.col("m").alias("v"))).distinct(), sweep=False)
        scratch.drop(least, large, low, pairs)
        pairs, mark = after, after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    scratch.sweep()
    # Settled pairs are stars: each node above its root, and the root itself.
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
