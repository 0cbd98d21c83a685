"""Connected components of a graph of bounded degree by contraction.

Each round every node points to its least neighbour (or itself), pointers are
followed to their roots, and the edges are rewritten between roots; a round
leaves at most half of the nodes that still have edges.  All tables stay
distributed; rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: More rounds than any input needs; a guard against a fault, not a limit on results.
MOST_ROUNDS = 64


def _roots(parents: DataFrame) -> DataFrame:
    """Follow (node, up), up < node or up = node, to the end."""
    for _ in range(MOST_ROUNDS):
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parents = stored(
            parents.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")),
            "roots",
        )
        moved = parents.filter("moved").limit(1).count()
        parents = parents.select("node", "up")
        if not moved:
            return parents
    raise RuntimeError("pointers did not settle")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge.  ``edges``: stored, columns a and b, a <> b, one direction is enough."""
    result = None
    for _ in range(MOST_ROUNDS):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up"))
        roots = _roots(stored(parents, "parents"))
        if result is None:
            result = roots
        else:
            higher = roots.select(F.col("node").alias("up"), F.col("up").alias("top"))
            result = stored(
                result.join(higher, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "components"
            )
        to_a, to_b = (roots.select(F.col("node").alias(x), F.col("up").alias(f"r{x}")) for x in "ab")
        joined = edges.join(to_a, "a").join(to_b, "b").filter("ra <> rb")
        edges = stored(
            joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "contracted"
        )
        if not edges.limit(1).count():
            return result.select("node", F.col("up").alias("root"))
    raise RuntimeError("components did not settle")
