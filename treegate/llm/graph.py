"""Connected components of a table of links, without bringing links to the driver.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components
in MapReduce and Beyond", 2014).  Each round is two aggregations of minima, which
combine before the shuffle, and two joins that Spark can split where a node is hot;
each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegate.llm.common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """edges (a long, b long) to (node long, component long): the least node that each node reaches.

    Only nodes that have a link appear. Nulls, loops and repeated links are ignored;
    no links give an empty table. The number of rounds grows with the logarithm of
    the longest shortest path.
    """
    now = work.write(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    mark, i = None, 0
    while True:
        i += 1
        following = work.write(_small_star(_large_star(now)), f"{name}{i}")
        seen = following.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        work.delete(f"{name}{i - 1}")
        now = following
        if mark == (seen.n, seen.h):
            break
        mark = (seen.n, seen.h)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
