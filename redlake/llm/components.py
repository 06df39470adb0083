"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A round halves paths at least; as many rounds as this join any that a table can hold.
MAX_ROUNDS = 64


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours linked to the smallest of it and them: those above it (large), or it and those below it."""
    if large:
        links = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Dealt out evenly first, the minima come to the join by a shuffle of their own, and a hub's links can be split there.
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).repartition(F.xxhash64("a"))
    met = links.join(least.hint("merge"), "a")
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the smallest node it is joined to.

    Null ends and links of a node to itself are left out; an empty table gives an empty one.
    A node with very many links is only ever counted and joined, never gathered. Each round
    is written, so that no lineage builds up. Links that need more than MAX_ROUNDS are an error.
    """
    downhill = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = written(downhill, "links"), None
    for _ in range(MAX_ROUNDS):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = written(_star(written(_star(now, True).distinct(), "links"), False).distinct(), "links")
    else:
        raise RuntimeError(f"components not settled in {MAX_ROUNDS} rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.union(ends.select("root", "root")).distinct()
