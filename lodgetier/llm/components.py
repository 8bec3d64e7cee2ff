"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetier.runtime import materialise


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): each linked node with the smallest node it can reach; `links` has longs a and b.

    Alternates two steps until nothing changes: hang a node's larger neighbours on its smallest one, then
    hang its smaller neighbours there too. Every step is a minimum per node and a join on the node, so no
    task holds a component, and the number of rounds grows with the logarithm of the longest chain. Each
    round is written, so that lost executors cost one round at most. Links from a node to itself and
    repeated links are harmless; no links give an empty table.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialise(ordered.where("a <> b").distinct(), "links")
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        edges = materialise(_small_star(_large_star(edges)), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError("the components didn't settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    low = F.least("a", "low")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), low.alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    edges = edges.where("a <> b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    hung = edges.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hung.unionByName(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
