"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free sum; equal states mean that nothing changed."""
    mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
    row = edges.agg(F.count(F.lit(1)), F.sum(mixed)).first()
    return tuple(row)


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the smallest node.

    Each round joins every node with the smallest of its neighbours, first among all, then
    among smaller ones, and drops repeated edges before the next.  The minimum is an aggregate
    that combines map-side and joins split skewed keys, so a node with very many edges needs no
    task of its own.  The number of rounds grows with the logarithm of the longest path.  Rounds
    are written to the checkpoint folder; loops and repeated edges do no harm, no edges give no
    rows.
    """
    now = cut_lineage(
        edges.where("a != b and a is not null and b is not null")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Every larger neighbour of a node goes to the node's smallest neighbour.
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        # Every smaller neighbour of a node, and the node, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = cut_lineage(small)
        before, state = state, _state(now)
        if state == before:
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(now.select("v", "v")).distinct()
