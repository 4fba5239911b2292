"""Connected components of graphs of rows, such as the similarity graph of a cluster's reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.stages import settle

ROUNDS = 40


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) -> (node, root): every node with the smallest it can reach.

    Each round takes the smallest label among a node's neighbours and that label's own; rounds are written to
    the shared folder.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    labels = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("root", F.col("node"))
    both, labels = settle(both, "component-edges"), settle(labels, "component-labels")
    last = None
    for _ in range(ROUNDS):
        offered = both.join(labels, F.col("u") == F.col("node")).groupBy(F.col("v").alias("n")).agg(F.min("root").alias("m"))
        near = labels.join(offered, F.col("node") == F.col("n"), "left").select("node", F.least("root", F.coalesce("m", "root")).alias("r"))
        jump = labels.select(F.col("node").alias("r"), F.col("root").alias("up"))
        moved = settle(near.join(jump, "r").select("node", F.least("r", "up").alias("root"), (F.col("r") > F.least("r", "up")).alias("__on")), "component-labels")
        state = moved.agg(F.count_if("__on").alias("on"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("sum")).first()
        labels = moved.drop("__on")
        if tuple(state) == last and not state.on:
            return labels
        last = tuple(state)
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def similarity_clusters(pairs: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, a, b, similarity) -> (keys, member, part): members of each group joined by pairs at or above the threshold.

    part is the least member that a member is joined to; members of pairs below the threshold only are their own.
    """
    node = lambda name: F.struct(*keys, F.col(name).alias("member"))
    members = pairs.select(node("a").alias("node")).union(pairs.select(node("b").alias("node"))).distinct()
    joined = components(pairs.where(F.col("similarity") >= threshold).select(node("a").alias("u"), node("b").alias("v")))
    out = members.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return out.select(*[F.col("node")[k].alias(k) for k in keys], F.col("node.member").alias("member"), F.col("root.member").alias("part"))
