"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultbench.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b) that isn't its component's smallest.

    a and b are bigints; a loop (a = b) links nothing. Each round only moves edges towards
    smaller nodes, so a component ends as one star around its smallest node, after a number
    of rounds that grows with the logarithm of the component's size. The driver sees two
    numbers a round; the edges are written to the shared checkpoint folder.
    """
    now = checkpointed(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    sign = None
    while True:
        got = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if got == sign or not got[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = got
        now = checkpointed(_small_star(_large_star(now)))
