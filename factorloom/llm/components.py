"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Edges for each task, about.
EDGES = 250_000


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """From edges (u, v) of long ids: (node, root) for each node that is not its component's smallest, root being that one.

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour; the number of
    rounds grows with the logarithm of a component's diameter. Smallest neighbours are aggregated before they are
    joined, and both sides of a join are stored tables, so that a node with very many edges can be split among tasks. `parts` says how
    many tasks the edges are worth, where that is known.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), parts)
    parts = now.count() // EDGES + 1
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), parts)
        large = materialize(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), parts)
        lower = materialize(large.groupBy("a").agg(F.min("b").alias("m")), parts)
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b")))
        after = materialize(small.distinct(), parts)
        discard(now, least, large, lower)
        now = after
