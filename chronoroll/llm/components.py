"""Connected components of links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, spread_join

#: Links beyond which hubs are spread; below, any one task can have them all.
SMALL = 200_000


def components(links: DataFrame, stash: Stash, most: int = 40) -> DataFrame:
    """``node``, ``comp``: the smallest node reachable, for every node of a link (``a``, ``b``).

    Alternates the two star operations: every node hands its larger neighbours to its
    smallest one, then its smaller ones. Both are a minimum per node, summed before the
    shuffle, and a join that doesn't gather the links of a hub in one task; rounds are logarithmic in the longest path, not in its length.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = stash.put(links.select(low, high).where("a <> b").distinct())
    before = n = None
    for _ in range(most):
        n = n or edges.count()
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c")).select("a", F.least("a", "m").alias("m"), "c")
        least = stash.put(least) if n > SMALL else least
        joined = spread_join(both, least, ["a"], 2 * n) if n > SMALL else both.join(least, "a")
        first = stash.put(joined.where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct())
        # Now the small star: of each node's smaller neighbours, all point to the smallest.
        low = first.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("c"))
        low = stash.put(low) if n > SMALL else low
        joined = spread_join(first, low, ["b"], first.count()) if n > SMALL else first.join(low, "b")
        small = joined.select(F.col("m"), F.explode(F.array("a", "b")).alias("x")).where("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        new = stash.put(small)
        stash.drop(edges, first, least, low)
        edges = new
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("comp"))
