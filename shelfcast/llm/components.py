"""Connected components by alternating stars; neither links nor components visit the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links its larger (large star) or smaller (small star) neighbours to the least of
    its neighbourhood.  The minimum is taken before the join, so a node with very many neighbours
    is one small row on that side and AQE may split the other."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("u"), F.least("a", "m").alias("m"))
    met = both.join(least, both.a == least.u)
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.filter("u != m").select("u", "m"))
    out = out.filter("a != b")
    return out if large else out.distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link only, to a node that has none to a lesser one: all are stars."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter(
        "up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): the least node that it reaches."""
    edges = stored(links.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        if _settled(edges):
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        edges = stored(_star(_star(edges, True), False), "stars")
    raise RuntimeError("components did not settle")
