"""Connected components of a graph that no single machine has to hold.

Each task contracts the edges it has, at most EDGES_A_TASK of them, to stars around the smallest id it sees. A node that
ends up in the stars of several tasks links their centres; those links are the edges of a smaller graph, which is
contracted in the same way, until none is left. The levels are then resolved from the smallest graph back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

EDGES_A_TASK = 1_000_000


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of an edge list, and the smallest node that each one reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(hop := root[root], root):
            root = hop
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[root]


def _contract(batches):
    """Stars (node, root) of the task's edges, a bounded number of edges at a time."""
    us, vs, n = [], [], 0

    def stars():
        nodes, roots = smallest_reachable(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

    for batch in batches:
        us.append(batch.column(0).to_numpy())
        vs.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n >= EDGES_A_TASK:
            yield stars()
            us, vs, n = [], [], 0
    if n:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest id reachable) for every node of `edges` (u long, v long). No edges, no rows."""
    levels = []
    edges = materialize(edges.select("u", "v"), "edges")
    while n := edges.count():
        tasks = -(-n // EDGES_A_TASK)
        packed = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks, F.least("u", "v"))
        stars = materialize(packed.mapInArrow(_contract, "node long, root long"), "stars")
        if tasks == 1:
            levels.append(stars)
            break
        first = stars.groupBy("node").agg(F.min("root").alias("root"))
        levels.append(first)
        edges = materialize(stars.withColumnRenamed("root", "u").join(first.withColumnRenamed("root", "v"), "node").filter("u != v").select("u", "v").distinct(), "edges")
    if not levels:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = levels.pop()
    while levels:
        up = found.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        found = levels.pop().join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return found.withColumnRenamed("root", "component")
