"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.session import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to the least node of its neighbourhood."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (two columns of one type that has an order); ``root`` is the least node it reaches.

    Alternates the two star steps until the edges no longer change, a number of rounds that grows with the logarithm
    of the longest path. Each round is written, so a lost executor repeats one round, and the round before it deleted. Repeated edges do no harm;
    a node whose only edge is a loop, and no edges at all, give no rows. A node with very many neighbours only meets them in minima and in joins that
    adaptive execution splits.
    """
    u, v = edges.columns
    now = materialise(
        edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "edges"
    )
    mark = None
    while True:
        sums = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if sums == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v")
            ).distinct()
        before, mark, now = now, sums, materialise(_small_star(_large_star(now)), "edges")
        discard(before)
