"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirloom.session import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node to the least of them and the node.

    A large star moves the larger neighbours, a small one the node and its smaller
    neighbours. The least comes from an aggregate that combines before the shuffle; a
    node with very many neighbours is split by the join.
    """
    if large:
        ways = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ways = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ways.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select(F.col("a").alias("of"), F.least("a", "least").alias("least"))
    moved = ways.filter("b > a") if large else ways
    out = moved.join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        out = out.unionAll(least.select(F.col("of").alias("a"), F.col("least").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b) whose least linked node is another one.

    Each round is written to the shared folder, so no plan grows and a lost executor
    costs one round at most. Rounds end when nothing changes.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == mark or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(now)
        for large in (True, False):
            before, edges = edges, materialize(_star(edges, large), "large-star" if large else "small-star")
            discard(before)
