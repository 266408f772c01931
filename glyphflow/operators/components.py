"""Connected components of a link table by alternating star contraction (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Rounds

#: Far beyond what the largest graph takes: rounds grow with the logarithm of a component's size.
MOST_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour (itself included)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that ``links`` (a, b: any type with an order) joins to another; the root is the smallest.

    Each round is two aggregations and two joins over the links, written to the shared folder; rounds grow with the
    logarithm of the component size. Nodes are summarised by their minimum, never gathered. Links with a null end
    and of a node to itself are left out; no links give no rows.
    """
    rounds, mark = Rounds(links.sparkSession, "links"), None
    now = rounds.saved(links.where("a <> b").select("a", "b"))
    for _ in range(MOST_ROUNDS):
        now = rounds.saved(_small_star(_large_star(now)))
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = state
    raise RuntimeError(f"the components haven't settled after {MOST_ROUNDS} rounds")
