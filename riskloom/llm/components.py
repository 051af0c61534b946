"""Distributed union-find over an edge table, DataFrame operations only.

Alternating large-star and small-star steps: each step links the neighbours
of a node to the smallest node it knows, so every component ends as one star
around its smallest node after a number of rounds that grows with the
logarithm of its size.  A hub is never gathered: minima are partial
aggregates, and the joins on a hub are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v); ``large`` also looks from the smaller ends."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # an edge whose larger end found nothing smaller than its own end stays through the other direction
        return out.where("u > v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u long, v long)`` in any direction -> ``(node, root)`` for every
    node with a link to another one; ``root`` is the smallest node of the
    component.  Self-links, repeats and nulls are ignored; no edges, no rows."""
    now = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
               "edges")
    seen = None
    for _ in range(max_rounds):
        now = save(_star(_star(now, True), False), "edges")
        sign = now.agg(F.count(F.lit(1)).alias("n"),
                       F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if sign == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = sign
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
