"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.session import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)`` (longs): the root is the component's smallest node.

    Each round points the larger neighbours of every node, then its smaller ones, at the smallest it knows; the
    number of rounds grows with the logarithm of the longest chain. Only two numbers a round reach the driver. Each
    round is a table in the shared folder, so a lost executor costs the running round at most. Loops (a = b), repeated
    links and links with a null are ignored; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    seen = None
    while True:
        signature = edges.agg(F.count("a"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if signature == seen or signature[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = signature
        edges = written(_small_star(_large_star(edges)), "links")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
