"""Connected components of an edge table by alternating large-star and small-star
rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barlake.session import written


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` undirected edges -> ``(node, component)``, component = smallest node reachable.

    Every round is two aggregations and two equi-joins on the edge table, whose
    partial minima absorb a hub's rows before the shuffle; the number of rounds grows
    with the logarithm of the longest path. Null ends and loops are dropped; nodes
    without an edge do not appear. Nothing but one count per round reaches the driver.
    """
    cur = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
           .where("u is not null and v is not null and u <> v").distinct())
    cur = written(cur, "cc")
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        # small star: every node with its lower neighbours hangs below the lowest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        nxt = written(nxt, "cc")
        changed = nxt.exceptAll(cur).limit(1).count() + cur.exceptAll(nxt).limit(1).count()
        cur = nxt
        if not changed:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
