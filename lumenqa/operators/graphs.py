"""Connected parts and the report of a selected subgraph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import cut


def connected_parts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, part) of every node of nodes(node), where part is the smallest node that edges(u, v) connect it with.

    In every round a node takes the least label of its neighbours and itself, then the label of that label, so labels travel by
    doubling steps along chains; rounds end when no label has changed. Edges with an end outside nodes are left out.
    """
    labels = cut(nodes.select("node").distinct().withColumn("part", F.col("node")))
    known = labels.select("node")
    for end in ("u", "v"):
        edges = edges.join(known.withColumnRenamed("node", end), end, "left_semi")
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    while True:
        told = both.join(labels.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("part").alias("seen"))
        near = labels.join(told, "node", "left").select("node", "part", F.least("part", F.coalesce("seen", F.col("part"))).alias("new"))
        jump = near.select(F.col("node").alias("new"), F.col("new").alias("further"))
        stepped = cut(near.join(jump, "new", "left").select("node", F.col("part").alias("old"), F.least("new", F.coalesce("further", F.col("new"))).alias("part")))
        labels = stepped.select("node", "part")
        if stepped.where("part <> old").isEmpty():
            return labels


def subgraph_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (nodes, edges, weighted_density, density, mean_degree, connected, parts, largest_part) of the subgraph that nodes(node) span in edges(u, v, w).

    An edge in both directions counts once, with its larger weight; loops don't count. weighted_density: weight over nodes;
    density: edges over possible ones; without nodes all numbers are 0 and nothing is connected.
    """
    nodes = cut(nodes.select("node").distinct())
    inside = edges.where("u <> v")
    for end in ("u", "v"):
        inside = inside.join(nodes.withColumnRenamed("node", end), end, "left_semi")
    inside = cut(inside.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("w").alias("w")))
    return report_of(inside, nodes, inside.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("weight")))


def report_of(joining: DataFrame, nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """subgraph_report() of edges of which only weights(edges, weight), one row, and some that join the same nodes, joining(u, v), are given."""
    sizes = connected_parts(joining, nodes).groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    whole = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("nodes"), F.count(F.lit(1)).alias("parts"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_part"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n, m = F.col("nodes"), F.col("edges")
    return whole.crossJoin(F.broadcast(weights)).select(  # two rows of one row each
        "nodes", "edges", share(F.col("weight"), n).alias("weighted_density"), share(2 * m, n * (n - 1)).alias("density"), share(2 * m, n).alias("mean_degree"), (F.col("parts") == 1).alias("connected"), "parts", "largest_part",
    )
