"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import cut, forget


def _stars(links: DataFrame) -> bool:
    """Whether each u has one v and no v is a u. As v < u, the middle of such a star is the smallest node of its component."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    wrong = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.max("down").alias("middle")).where("ups > 1 or ups = 1 and middle = 1")
    return not wrong.take(1)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): root is the smallest node that can be reached. Nodes without a link aren't listed.

    Every node passes on the smallest node that it sees: first to its larger neighbours, then to its smaller ones, so that each
    round joins stars with stars and the number of rounds grows with the logarithm of the longest chain. Rounds are cut by a
    checkpoint. Minima are aggregated before they are shuffled, and cut too: the joins that hand them out then have a plain exchange on
    either side, which adaptive execution can split, so a star with very many leaves doesn't meet in one task. Rounds end once all links
    form stars; links that do so from the start need no round. What a round wrote is deleted once the next one has its links.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(links):
        # larger neighbours (and the node itself) move under the smallest neighbour
        both = links.union(links.select("v", "u")).toDF("x", "y")
        least = cut(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
        large = cut(both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        # smaller neighbours move under the smallest of them
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, links = links, cut(small.where("u <> v").distinct())
        forget(before, least, large, low)
    roots = links.select("v").distinct()
    return links.union(roots.select("v", "v")).toDF("node", "root")
