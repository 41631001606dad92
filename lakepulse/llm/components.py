"""Connected components of a graph of any size, by rounds of joins.

Each round makes larger neighbours point to the smallest one (large star), then smaller ones (small star), until
nothing changes; the graph is then a set of stars around the smallest node of each component. Rounds grow with
the logarithm of the longest path. Each is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepulse.session import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a's neighbours b: each neighbour and a itself point to the smallest of them all."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    around = edges.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = smallest.select("a", F.col("m").alias("b"))
    return around.union(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each node of ``edges`` (a, b) reaches; nodes without edges are left out."""
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    n, total = -1, None
    while True:
        both = _both(now)
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = larger.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = written(_star(down), "stars")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == (n, total):
            break
        n, total = seen["n"], seen["s"]
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(stars.select("label", "label").distinct())
