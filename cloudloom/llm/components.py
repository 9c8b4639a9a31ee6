"""Connected components by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import cut, dropped


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b. Each node is linked to the least of it and its neighbours: by the large star those above it, by the small one those below it and itself."""
    both = edges.union(edges.select("b", "a")) if large else edges
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    near = both.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
    else:
        out = near.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a <> b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) of any ordered type; node and root (the least node of its component) for every node of a pair that is not its root."""
    edges = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        before, edges = edges, cut(_star(_star(edges, True), False), "edges")
        dropped(before)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            out = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
            dropped(edges)
            return out
        mark = now
