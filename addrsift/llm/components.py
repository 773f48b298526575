"""Connected components of an edge table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of a node to the least of its neighbourhood."""
    both = edges.unionByName(_turned(edges))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node is linked with one other, which is linked no further."""
    ends = edges.select("a", F.lit(1).alias("n")).unionByName(edges.select(F.col("b").alias("a"), F.lit(None).cast("int").alias("n")))
    wrong = ends.groupBy("a").agg(F.count("n").alias("up"), F.count("*").alias("all")).filter("up > 1 OR (up = 1 AND all > 1)")
    return wrong.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that has an edge and is not the least of its component,
    with that least node.  Edges may repeat or point either way; loops are
    ignored.  The number of steps is logarithmic in the longest path.
    """
    edges = edges.select("a", "b").filter("a <> b")
    while True:
        edges = staged(_small_star(_large_star(edges)), "stars")
        if _stars(edges):
            return edges
