"""Connected components of a link table by star contraction: union-find as joins and aggregates.

Each round hangs the neighbours of a node below its smallest neighbour, first the larger ones, then the smaller
ones. Trees become stars after a number of rounds that grows with the logarithm of the longest chain. Every round is
written to the shared folder. Minima are pre-aggregated before the shuffle, and the joins on a hub node carry two
numbers per row and have nothing above them that needs a node's rows together, so adaptive execution may split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.storage import saved

ROUNDS = 100


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other node, and that one on none."""
    found = edges.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("nodes")).first()
    if found.n != found.nodes:
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of a link to another node; root is the smallest node reachable.

    Nulls, loops, repeated links and either direction of a link are allowed; an empty table gives an empty result.
    """
    a, b = F.col(left), F.col(right)
    edges = saved(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    for _ in range(ROUNDS):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        larger = (
            both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        )
        larger = saved(larger.distinct(), "larger")
        below = larger.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        smaller = larger.join(below, "u").select(F.explode(pairs).alias("p")).select("p.u", "p.v").filter("u <> v")
        edges = saved(smaller.distinct(), "smaller")
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
