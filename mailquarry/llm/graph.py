"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import cut, drop_cut


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps: each round hangs every node under the smallest neighbour, keeps
    connectivity, and never makes more edges than there were, so a hub costs as many rows as it has neighbours. Rounds end
    when the edges stay the same; their number grows with the logarithm of the longest path. Only a count and a checksum
    reach the driver."""
    now = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        low2 = large.groupBy(F.greatest("x", "y").alias("u")).agg(F.min(F.least("x", "y")).alias("m"))
        down = large.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        small = down.join(low2, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low2.select("u", "m"))
        then = cut(small.where("a <> b").distinct(), "edges")
        mark = then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_cut(now)
        now = then
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
