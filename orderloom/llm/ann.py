"""Nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample of vectors, about SAMPLE chosen by a hash of the id; every vector is then put into
a leaf. A query's leaves are taken from a priority queue of nodes in order of the inner product with their centroids. How
many leaves are visited is calibrated: on queries from the sample, with the sample's exact neighbours, visits widen until
the recall reaches TARGET. All vectors of visited leaves are compared in double precision; rows as near as the k-th all
stay until ids decide.

Inner products need equal lengths, so vectors of each length are searched among themselves: each length has a tree of
its part of the sample, or a single leaf, which is searched whole, where that part is too small for one. Equal vectors
are one class, of which the smallest k + 1 ids can ever be among the k nearest, so a vector repeated in a third of the
rows is compared once. Large leaves are cut into blocks, and queries of much visited leaves into parts, so that a task's
share is bounded. The trees, whose leaves the sample bounds, and a count for each leaf are all that is broadcast.

A sample of SAMPLE vectors gives SAMPLE / 8 leaves at most: from LEAF * SAMPLE / 8 vectors on, leaves grow with the table,
in blocks, and so does the work of a query. A larger sample is then the parameter to raise.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do
those without an id; rows that repeat id and vector count once; a query's own id is no candidate; with fewer candidates
than k, all are returned; products that overflow are infinite, and rank last where that leaves them undefined; an empty
table gives an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table

#: Vectors that trees are fitted on, about; children of a node; vectors of a leaf, about; least of a sample for a leaf.
SAMPLE, CHILDREN, LEAF, LEAST = 32_768, 8, 512, 8
#: Recall that calibration must reach on the sample, and queries it uses; vectors of a block and queries of a part.
TARGET, TRIALS, BLOCK, PART = 0.96, 384, 4096, 8192
#: Hashes that the sample is a share of.
SHARES = 1 << 30


@dataclass
class Tree:
    """Centroids of all nodes; children of inner nodes; leaf numbers of the others."""

    centroids: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    scale: float = 1.0
    first: int = 0
    visits: int = 1

    def scaled(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as the tree sees them: finite squares, whatever their components."""
        return np.clip(vectors * self.scale, -1e6, 1e6)

    @property
    def leaves(self) -> int:
        return sum(n >= 0 for n in self.leaf)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each scaled vector, by the nearest centroid from the root down."""
        out, todo = np.zeros(len(vectors), np.int32), [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                below = np.array(self.children[node])
                best = _nearest(vectors[rows], self.centroids[below])
                todo += [(int(c), rows[best == k]) for k, c in enumerate(below)]
        return out

    def order(self, near: np.ndarray) -> Iterator[int]:
        """Leaves in order of visits, for a query's inner products with all centroids."""
        heap = [(-near[0], 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            for c in self.children[node]:
                heapq.heappush(heap, (-near[c], c))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * (x @ centroids.T)).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best = _nearest(x, centroids)
        for j in range(k):
            if (own := best == j).any():
                centroids[j] = x[own].mean(axis=0)
    return centroids


def fit_tree(sample: np.ndarray, rows: int, seed: int = 5) -> Tree:
    """A tree whose leaves hold about LEAF of all rows, and LEAST of the sample."""
    most = np.abs(sample).max()
    scale = 1 / most if 0 < most < np.inf else 1.0
    sample = np.clip(sample * scale, -1e6, 1e6)
    rng, wanted = np.random.default_rng(seed), max(1, rows // LEAF)
    least = max(LEAST, len(sample) // wanted)
    centroids, children, leaf, members = [sample.mean(axis=0)], [[]], [-1], [np.arange(len(sample))]
    node = 0
    while node < len(centroids):
        own = members[node]
        k = min(CHILDREN, len(own) // least)
        parts = []
        if k > 1:
            means = _kmeans(sample[own], k, rng)
            best = _nearest(sample[own], means)
            parts = [(means[j], own[best == j]) for j in range(k) if (best == j).any()]
        if len(parts) > 1:
            for mean, rows_below in parts:
                children[node].append(len(centroids))
                centroids.append(mean)
                children.append([])
                leaf.append(-1)
                members.append(rows_below)
        else:
            leaf[node] = sum(n >= 0 for n in leaf)
        node += 1
    return Tree(np.array(centroids), children, leaf, scale)


def calibrate(tree: Tree, sample: np.ndarray, k: int) -> Tree:
    """Widen the visits until the sample's queries find TARGET of their k nearest in the sample."""
    sample = tree.scaled(sample)
    at = np.unique(np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int))
    trials, leaves = sample[at], tree.assign(sample)
    scores, near = trials @ sample.T, trials @ tree.centroids.T
    scores[np.arange(len(at)), at] = -np.inf
    some = min(k, len(sample) - 1)
    top = np.argpartition(-scores, some, axis=1)[:, :some]
    found = np.zeros(tree.leaves + 1)
    for row, own in enumerate(top):
        place = {leaf: n for n, leaf in enumerate(tree.order(near[row]))}
        np.add.at(found, [place[x] for x in leaves[own]], 1)
    recall = np.cumsum(found) / max(1, found.sum())
    tree.visits = int(np.searchsorted(recall, min(TARGET, recall[-1]))) + 1
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors) of a column."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield n, rows, _matrix(column.take(pa.array(rows)))


def plant(sample: pa.Array, counts: dict[int, int], k: int) -> dict[int, Tree]:
    """A tree for each length of which the sample has enough; leaves are numbered through."""
    forest, first = {}, 0
    for n, _, vectors in _by_length(sample):
        if len(vectors) >= 2 * LEAST and counts.get(n, 0) >= 2 * LEAF:
            forest[n] = calibrate(fit_tree(vectors, counts[n]), vectors, k)
            forest[n].first, first = first, first + forest[n].leaves
    return forest


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    two = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return two.where(F.forall("embedding", real)).where(F.exists("embedding", lambda x: x != 0))


def _leaves_of(forest):
    """Classes with their leaf: of a length without a tree, the negative length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = np.zeros(b.num_rows, np.int32)
            for n, rows, x in _by_length(b.column(0)):
                tree = forest.value.get(n)
                leaf[rows] = tree.first + tree.assign(tree.scaled(x)) if tree else -n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], [*b.schema.names, "leaf"])

    return run


def _visits_of(forest, counts: dict[int, int], k: int):
    """Queries with the leaves that they visit: as many as calibrated, more until they hold over k vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list = [[] for _ in range(b.num_rows)]
            for n, rows, x in _by_length(b.column(1)):
                tree = forest.value.get(n)
                if tree is None:
                    for r in rows.tolist():
                        out[r] = [-n]
                    continue
                near = tree.scaled(x) @ tree.centroids.T
                for r, row in zip(rows.tolist(), near):
                    held = 0
                    for leaf in tree.order(row):
                        if len(out[r]) >= tree.visits and held > k:
                            break
                        out[r].append(tree.first + leaf)
                        held += counts.get(tree.first + leaf, 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], [*b.schema.names, "visits"])

    return run


def _compare(k: int):
    """A block of a leaf against a part of its queries: of each the k + 1 nearest, smaller ids first among equals."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_hits = [], []
        if left.num_rows and right.num_rows:
            v, ids = _matrix(right.column("embedding").combine_chunks()), right.column("ids").combine_chunks()
            q, x = left.column("q").to_pylist(), _matrix(left.column("embedding").combine_chunks())
            some = min(len(v), k + 1)
            with np.errstate(over="ignore", invalid="ignore"):
                scores = np.zeros((0, 0))
                for row, own in enumerate(x):
                    if not row % 64:
                        scores = x[row : row + 64] @ v.T
                    score = scores[row % 64]
                    score[np.isnan(score)] = -np.inf
                    edge = np.partition(score, len(v) - some)[len(v) - some]
                    # Sums in another order may differ in their last digits: all rows near the edge are summed alike.
                    slack = 1e-9 * float(np.abs(v).max() * np.abs(own).max()) * v.shape[1]
                    at = np.flatnonzero(score >= edge - slack) if np.isfinite(edge) and np.isfinite(slack) else np.flatnonzero(score >= edge)
                    exact = (v[at] * own).sum(axis=1)
                    far = np.where(np.isnan(exact), np.inf, -exact)
                    own_ids = ids.take(pa.array(at))
                    each = pc.list_value_length(own_ids).to_numpy(zero_copy_only=False)
                    flat, far = own_ids.flatten().to_numpy(zero_copy_only=False), np.repeat(far, each)
                    first = np.lexsort((flat, far))[: k + 1]
                    out_q.append(q[row])
                    out_hits.append([{"far": f, "id": i} for f, i in zip(far[first].tolist(), flat[first].tolist())])
        return pa.table({"q": pa.array(out_q, pa.int64()), "hits": pa.array(out_hits, pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())])))})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query; queries are rows (query_id) of vectors."""
    spark = vectors.sparkSession
    rows = staged(usable(vectors, id_col, vector_col), "usable")
    by = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.distinct().withColumn("place", F.row_number().over(by)).where(F.col("place") <= k + 1)
    classes = staged(first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    counts = {r["n"]: r["count"] for r in classes.groupBy(F.size("embedding").alias("n")).count().collect()}
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not counts:
        return spark.createDataFrame([], schema)
    share = max(1, SHARES * SAMPLE // sum(counts.values()))
    sample = classes.select("embedding", F.xxhash64(F.col("ids")[0]).alias("hash")).where(F.pmod("hash", F.lit(SHARES)) < share).toArrow().sort_by("hash")
    forest = spark.sparkContext.broadcast(plant(sample.column("embedding").combine_chunks(), counts, k))
    placed = staged(classes.mapInArrow(_leaves_of(forest), T.StructType([*classes.schema.fields, T.StructField("leaf", T.IntegerType())])), "leaves")
    held = staged(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).select("leaf", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "held")
    in_leaf = {r["leaf"]: r["n"] for r in held.collect()}
    asked = rows.join(queries.select(F.col("query_id").alias("vec_id")).where("vec_id is not null").distinct(), "vec_id").distinct()
    asked = staged(asked, "asked")
    distinct = asked.groupBy("embedding").agg(F.min("vec_id").alias("q")).select("q", "embedding")
    visits = distinct.mapInArrow(_visits_of(forest, in_leaf, k), T.StructType([*distinct.schema.fields, T.StructField("visits", T.ArrayType(T.IntegerType()))])).select("q", "embedding", F.explode("visits").alias("leaf"))
    visits = staged(visits, "visits")
    parts = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    sizes = F.broadcast(staged(held.join(parts, "leaf").select("leaf", "blocks", "parts"), "sizes"))  # a row for each leaf, which the sample bounds
    asks_by = visits.join(sizes, "leaf").select("q", "embedding", "leaf", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    block = F.pmod(F.xxhash64(F.col("ids")[0]), F.col("blocks")).cast("int").alias("block")
    held_by = placed.join(sizes, "leaf").select("embedding", "ids", "leaf", block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    keys = ("leaf", "block", "part")
    found = asks_by.groupBy(*keys).cogroup(held_by.groupBy(*keys)).applyInArrow(_compare(k), "q bigint, hits array<struct<far:double,id:bigint>>")
    merged = found.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, k + 1).alias("hits"))
    members = asked.join(distinct.withColumnRenamed("embedding", "own"), F.col("embedding") == F.col("own")).select(F.col("vec_id").alias("query_id"), "q")
    own = members.join(staged(merged, "merged"), "q").withColumn("hits", F.slice(F.filter("hits", lambda h: h.id != F.col("query_id")), 1, k))
    return own.select("query_id", F.posexplode("hits").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score")
    )


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")))
