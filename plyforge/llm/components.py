"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm.common import discard, written


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and two sums of their hashes: equal marks mean equal tables."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edge table with long columns ``a`` and ``b``; ``root`` is
    the smallest node that can be reached.

    Each round hangs all larger neighbours of a node on its smallest one (large star), then all
    smaller ones (small star), until nothing changes: O(log n) rounds also for chains. A star's
    minimum is a partial aggregate that is written before it is joined: both sides of the join then come
    from a shuffle of their own, and adaptive execution can split a node with very many neighbours. Every
    round is written to the shared folder, and what the round before wrote is removed. Self-loops and repeated edges are harmless; an empty table
    gives no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = edges.where("a is not null and b is not null and a != b")
    edges = written(edges.select(high.alias("a"), low.alias("b")).distinct(), name)
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = both.where("b > a").join(first, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a != b").distinct(), name)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        before = edges, first, large, least
        edges = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        discard(*before)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
