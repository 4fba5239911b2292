"""Connected components of an edge list by alternating star contraction.

Each round replaces edges so that the nodes of a component gather under its smallest node; the number of
rounds grows with the logarithm of the longest path. Edges are written to the shared folder after each
round, which cuts the lineage; the nodes are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import materialize

MAX_ROUNDS = 60


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v) in both directions -> smallest of u and its neighbours, for each u; combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))


def _stars(edges: DataFrame, large: bool, name: str) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a hub that is its own smallest stays: only the other nodes' minima are joined, and from a written
        # table, so that both sides of the join come straight from a shuffle and a hub can be split
        moving = materialize(_min_neighbour(both).where("m < node"), f"{name}-moving")
        moved = both.where("v > u").join(moving, F.col("u") == F.col("node"), "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined = down.join(_min_neighbour(down), F.col("u") == F.col("node"))
        moved = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (u, v) of any ordered type -> (node, root): every node of an edge with the smallest it can reach.

    Self-loops and repeated edges have no effect (a node with nothing but a self-loop is left out). An
    empty edge list gives no rows.
    """
    edges = materialize(edges.where("u <> v").select("u", "v").distinct(), name)
    last = None
    for _ in range(MAX_ROUNDS):
        edges = materialize(_stars(_stars(edges, True, name), False, name), name)
        # stable when the edges are stars: the sum over edges and their number stay the same
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
