"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotide.session import cut_lineage

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex ties its larger neighbours to the smallest vertex it knows."""
    around = _both(edges)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex ties itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.union(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a, root`` for each vertex of ``edges`` (``a, b`` bigint) that is not itself the smallest of its component.

    Loops are ignored. Steps end when all edges point at roots; rounds grow with
    the logarithm of the longest path.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        # Done when no root of an edge has itself a smaller neighbour, and no vertex has two.
        state = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if state.where("n > 1").isEmpty() and edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            return edges.select("a", F.col("b").alias("root"))
        edges = cut_lineage(_small_star(_large_star(edges)))
    raise RuntimeError("components did not settle")
