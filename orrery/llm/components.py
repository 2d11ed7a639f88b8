"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import discard, stored

MAX_ROUNDS = 60


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and all its v. The join's sides are free to be split where u is hot."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u bigint, v bigint); root is the least node that can be reached.

    Nothing is collected but two sums a round. Each round ends in a written table. Edges with a null end or two equal ones count
    for nothing, repeated ones once; no edges give no rows. Rounds grow with the logarithm of a component's length; MAX_ROUNDS
    (2^60 nodes in a chain) raise.
    """
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    said = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "large-star")
        discard(edges)
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stored(small, "small-star")
        discard(large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == said:
            # Nothing changed in a whole round, so every node points at its root.
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
        said = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
