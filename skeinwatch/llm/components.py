"""Connected components of an undirected graph given by its links, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import shared_dir


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `root` (the smallest node reachable) for every node that has a link.

    Rounds of large-star and small-star steps: every node tells its larger, then its smaller
    neighbours the smallest one it knows, until nothing changes. Links never multiply. Each round is cut
    off with a checkpoint in the shared folder; only a count and a sum come to the driver. Minima
    are aggregated before the join with the links, which Spark may split at hubs.
    """
    shared_dir(links.sparkSession)
    pair = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    edges = links.filter(F.col(a) != F.col(b)).select(*pair).distinct().checkpoint()
    before = _state(edges)
    while before[0]:
        edges = _small_star(_large_star(edges)).checkpoint()
        after = _state(edges)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of links; sums of 32-bit hashes cannot overflow."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(0x7FFFFFFF)), F.sum(F.shiftrightunsigned(h, 33))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    told = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return told.filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Here every link leads from u to a smaller v."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    told = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return told.filter("u != v").distinct()
