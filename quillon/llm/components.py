"""Connected components by alternating large-star and small-star.

Edges stay in DataFrames; each star is one aggregate (with partial sums on the map side, so hubs are cheap) and one
join whose hot keys adaptive execution can split. Each step is written to the shared folder. Nothing but two numbers
(a count and a checksum) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, spread_join


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return spread_join(both.where("v > u"), least, "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = spread_join(down, least, "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """(u, v) for every node that isn't the least of its component: v is the least.

    edges has integer columns u and v. Loops, repeated edges and either direction are fine; nulls are not links.
    """
    now = work.table(edges.where("u <> v").select("u", "v").distinct(), f"{name}-0")
    seen, step = None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now
        seen, step = state, step + 1
        large = work.table(_large_star(now), f"{name}-{step}a")
        after = work.table(_small_star(large), f"{name}-{step}b")
        work.drop(f"{name}-{step}a")
        work.drop(f"{name}-{step - 1}b" if step > 1 else f"{name}-0")
        now = after
