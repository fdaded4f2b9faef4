"""Connected components by alternating stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowsift.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of ``edges (a, b)``; the component is its smallest id.

    Each round points every node at the smallest node of its surroundings (first its larger, then
    its smaller neighbours), so paths shrink by half or more and the rows never outnumber the
    links. Minima are combined before the shuffle; only pairs move, so a node with very many links
    is a join that can be split.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = stored(edges.distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a != b").distinct(), "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    heads = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(heads)
