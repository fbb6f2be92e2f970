"""Connected components over an edge table, without gathering the graph anywhere.

Each round every node hooks to its smallest neighbour, pointers are jumped until
they rest on a root, and the edges are contracted to the roots. All steps are
joins and partially aggregated minima, so a hub with millions of links is folded
before the shuffle and its join side can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _canonical(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("a", "b")
    )


def _rooted(parents: DataFrame) -> DataFrame:
    """Pointer jumping: (node, root) with root the end of each parent chain."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = materialize(
            parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")),
            "jump",
        )
        moved = not jumped.where("moved").isEmpty()
        discard(parents)
        parents = jumped
        if not moved:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, root)``: root is the smallest node reachable.

    Only nodes of at least one edge between different nodes are returned. An empty
    edge table gives an empty result.
    """
    left = materialize(_canonical(edges.select("a", "b")), "edges")
    rooted = None
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        roots = _rooted(materialize(hooked, "hooks"))
        step = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        if rooted is None:
            joined = roots.select("node", "root")
        else:
            joined = rooted.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        new = materialize(joined, "rooted")
        to_a, to_b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        next_left = materialize(_canonical(left.join(to_a, "a").join(to_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
        discard(left, roots, *([rooted] if rooted is not None else []))
        left, rooted = next_left, new
    if rooted is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted
