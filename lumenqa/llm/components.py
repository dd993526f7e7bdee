"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, map_batches, remove, write_out

#: Edges that a task contracts at once; as few are left to one task.
FOREST_EDGES = 1_000_000


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that these edges reach from each): larger roots hang on smaller ones until no edge joins two."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    parent = np.arange(len(nodes))
    while (apart := parent[a] != parent[b]).any():
        a, b = a[apart], b[apart]
        x, y = parent[a], parent[b]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while ((up := parent[parent]) != parent).any():
            parent = up
    return nodes, nodes[parent]


def _forest(edges: DataFrame, loops: bool = False) -> DataFrame:
    """Fewer edges with the same components: each task replaces runs of its edges by one for each node but the roots, or for roots too."""

    def contract(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        nodes, roots = _roots(u, v)
        keep = (nodes != roots) | loops
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["u", "v"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= FOREST_EDGES:
                yield contract(held)
                held, size = [], 0
        if size:
            yield contract(held)

    return map_batches(edges, run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return near.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (u long, v long); component is the smallest node.

    Repeated edges, loops and both directions are allowed; null ends are not. Nodes that only have loops are left out; an
    empty table gives an empty one. Each turn's edges are written once to the shared checkpoint folder; the turn before
    is deleted then. Once FOREST_EDGES or fewer are left, one task contracts them, which is exact and bounded.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if edges.count() > FOREST_EDGES:
        edges, folder = write_out(_forest(_forest(edges).distinct()))
        state = _state(edges)
        while state[0] > FOREST_EDGES:
            past, (edges, folder) = folder, write_out(_small_star(_large_star(edges)))
            remove(edges.sparkSession, past)
            if (now := _state(edges)) == state:
                stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
                return cut(stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
            state = now
    return cut(_forest(edges.coalesce(1), loops=True).toDF("node", "component"))
