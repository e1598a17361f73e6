"""Connected components of an edge list: in one executor's task up to a counted number of edges, by star rounds beyond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Edges that one task may hold, 16 bytes each; more go through rounds of joins.
TASK_EDGES = 1 << 19


def _minima(edges: DataFrame) -> DataFrame:
    """The least of each u and its neighbours v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges but the roots, and their roots: roots of joined trees point to the smaller, paths are halved."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, parent = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(u):
        a, b = parent[u], parent[v]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        apart = parent[u] != parent[v]
        u, v = u[apart], v[apart]
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        found = _roots(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "root"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) of every node of edges (u, v), longs, but the roots; a root is the smallest node of its component.

    Beyond task_edges each round groups with partial aggregation and joins on the node, so a node with very many edges is summed
    map-side and its join partition can be split. A round's edges are written before the next begins."""
    now, seen = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    if now.count() <= task_edges:
        return staged(now.coalesce(1).mapInArrow(_in_task, "node bigint, root bigint"), "components")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both), F.col("u") == F.col("node")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large")
        least = _minima(large)
        small = large.join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
        now = staged(small.where("u <> v").distinct(), "small")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
