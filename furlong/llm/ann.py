"""Operator 3: approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on at most ``SAMPLE_ROWS`` vectors, the ones whose id has the
smallest hash; every vector is then filed in one leaf of each tree.  A query
searches all trees through one shared priority queue: the node with the best
margin comes next, its nearer side is followed to a leaf, the farther side
goes into the queue, until the leaves reached hold ``SEARCH`` of the filed
vectors (as the sample tells).  The leaves' vectors are reranked by exact
distance, on the original vectors in double precision.

Vectors and queries meet by leaf.  Leaves that hold more than ``LEAF_ROWS`` vectors or
queries are split over several tasks, and a task sends on its ten best for
each query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furlong.llm._shared import stored
from furlong.llm.hnsw import valid_vectors

SAMPLE_ROWS = 65_536
TREES = 6
LEAVES, LEAST_LEAF = 256, 16
SEARCH = 1.5
LEAF_ROWS = 4096


@dataclass
class Tree:
    """Nodes in arrays; a node with no children is a leaf, ``leaf`` its number."""

    normals: np.ndarray
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray  # of the sample, by node

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf (its node) of each row."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return at
            i = np.flatnonzero(inner)
            side = np.einsum("ij,ij->i", x[i], self.normals[at[i]]) > self.offsets[at[i]]
            at[i] = np.where(side, self.right[at[i]], self.left[at[i]])


def plant(sample: np.ndarray, rng: np.random.Generator, leaf: int) -> Tree:
    """A tree of median splits along the difference of two random points."""
    normals, offsets, left, right, size = [], [], [], [], []

    def new(n: int) -> int:
        normals.append(np.zeros(sample.shape[1]))
        offsets.append(0.0)
        left.append(-1)
        right.append(-1)
        size.append(n)
        return len(left) - 1

    todo = [(new(len(sample)), np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf:
            continue
        a, b = rng.choice(rows, 2, replace=False)
        normal = sample[a] - sample[b]
        norm = np.sqrt(normal @ normal)
        if norm == 0:
            normal = rng.standard_normal(sample.shape[1])
            norm = np.sqrt(normal @ normal)
        normal /= norm
        z = sample[rows] @ normal
        cut = float(np.median(z))
        high = z > cut
        if not high.any() or high.all():
            continue  # equal vectors can't be told apart
        normals[node], offsets[node] = normal, cut
        left[node], right[node] = new(int((~high).sum())), new(int(high.sum()))
        todo += [(left[node], rows[~high]), (right[node], rows[high])]
    return Tree(np.stack(normals), np.array(offsets), np.array(left), np.array(right), np.array(size))


class Forest:
    """Trees of about ``leaves`` leaves each, of no fewer than ``LEAST_LEAF`` sample rows, numbered through all trees.

    So trees of a small table part it as finely as those of a large one, and a share of the vectors means the same for both.
    """

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaves: int = LEAVES, seed: int = 5):
        rng = np.random.default_rng(seed)
        leaf = max(LEAST_LEAF, -(-len(sample) // leaves))
        self.trees = [plant(sample, rng, leaf) for _ in range(trees)]
        self.base = np.cumsum([0] + [len(t.left) for t in self.trees])
        self.rows = len(sample)

    def file(self, x: np.ndarray) -> np.ndarray:
        """Rows x trees: leaf numbers."""
        return np.stack([t.leaves(x) + b for t, b in zip(self.trees, self.base[:-1], strict=True)], 1)

    def search(self, query: np.ndarray, want: float) -> list[int]:
        """Leaves by a queue shared by all trees, until they hold ``want`` sample rows, counted once a leaf."""
        queue = [(0.0, i, 0) for i in range(len(self.trees))]
        found, held = [], 0
        while queue and held < want:
            margin, i, node = heapq.heappop(queue)
            t = self.trees[i]
            while t.left[node] >= 0:
                d = float(query @ t.normals[node]) - t.offsets[node]
                near, far = (t.right[node], t.left[node]) if d > 0 else (t.left[node], t.right[node])
                heapq.heappush(queue, (max(margin, abs(d)), i, int(far)))
                node = near
            found.append(int(self.base[i] + node))
            held += int(t.size[node])
        return found


def _filer(shared, search: float | None):
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if search is None:
                leaves = forest.file(x).tolist()
            else:
                leaves = [forest.search(q, search) for q in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaves, pa.list_(pa.int32()))], names=["id", "v", "leaves"])

    return file


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed over the components' differences in order of component."""
    return np.sqrt(((q - x) ** 2).sum(-1))


def _reranker(k: int):
    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by leaf and part: its queries (kind 0), then its vectors (kind 1); keeps the k best of each query so far."""
        best_id: dict[int, np.ndarray] = {}
        best_d: dict[int, np.ndarray] = {}
        at, ids, qs, matrix, pend_i, pend_v = None, [], [], None, [], []

        def flush():
            nonlocal pend_i, pend_v, matrix
            if pend_i and ids:
                if matrix is None:
                    matrix = np.stack(qs)
                x, xi = np.stack(pend_v), np.array(pend_i, np.int64)
                xx = np.einsum("ij,ij->i", x, x)
                rough = xx[None] - 2 * (matrix @ x.T) + np.einsum("ij,ij->i", matrix, matrix)[:, None]
                m = min(len(xi), k + 6)  # the nearest by matrix product, then their exact distances
                near = np.argpartition(rough, m - 1, 1)[:, :m]
                for r, q in enumerate(ids):
                    cand = near[r]
                    if m < len(xi):  # ties with the last one kept take part
                        last = rough[r, cand].max()
                        cand = np.flatnonzero(rough[r] <= last + 1e-9 * (1 + xx.max() + float(matrix[r] @ matrix[r])))  # the product's error goes with the norms
                    i = np.concatenate([best_id.get(q, np.zeros(0, np.int64)), xi[cand]])
                    d = np.concatenate([best_d.get(q, np.zeros(0)), distances(matrix[r], x[cand])])
                    other = i != q
                    i, first = np.unique(i[other], return_index=True)
                    d = d[other][first]
                    top = np.lexsort((i, d))[:k]
                    best_id[q], best_d[q] = i[top], d[top]
            pend_i, pend_v = [], []

        def out() -> pa.RecordBatch:
            q = np.repeat(np.array(list(best_id), np.int64), [len(x) for x in best_id.values()])
            rows = pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate(list(best_id.values()))), pa.array(np.concatenate(list(best_d.values())))], names=["query_id", "vec_id", "score"])
            best_id.clear()
            best_d.clear()
            return rows

        for batch in batches:
            values = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else None
            for r, (leaf, vpart, qpart, kind, i) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 1, 2, 3)], batch.column(5).to_pylist(), strict=True)):
                if (leaf, vpart, qpart) != at:
                    flush()
                    at, ids, qs, matrix = (leaf, vpart, qpart), [], [], None
                if kind == 0:
                    ids.append(i)
                    qs.append(values[r])
                else:
                    pend_i.append(i)
                    pend_v.append(values[r])
                    if len(pend_i) >= 2048:
                        flush()
            if len(best_id) > 100_000:
                yield out()
        flush()
        if best_id:
            yield out()

    return rerank


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", search: float = SEARCH) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k nearest vectors found for each query, the query's own id left out; ties to the smaller id.

    ``search`` is the share of the filed vectors that a query looks through, counted over all trees; a table of any size is searched alike.
    Vectors and queries of null id, or that are null, empty or zero or hold null or
    non-finite components, take no part, nor do those of another length than
    the queries' most usual one (of equally usual ones the least).  Repeated ids are one vector, the first in order.  Extra
    columns are ignored; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    good = lambda df: valid_vectors(df, id_col, vector_col).filter("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    asked = stored(good(queries), "queries")
    one = asked.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if one is None:
        return spark.range(0).select(F.col("id").alias("query_id"), F.col("id").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("id").cast("double").alias("score"))
    filed = stored(good(vectors).filter(F.size("v") == one["d"]), "vectors")
    asked = asked.filter(F.size("v") == one["d"])
    rows = filed.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    sample = np.stack(rows["v"].to_numpy()) if len(rows) else np.zeros((0, one["d"]))
    shared = spark.sparkContext.broadcast(Forest(sample))
    want = search * len(sample)

    leaves = stored(filed.mapInArrow(_filer(shared, None), "id long, v array<double>, leaves array<int>"), "filed")
    seeks = stored(asked.mapInArrow(_filer(shared, want), "id long, v array<double>, leaves array<int>"), "seeks")
    count = lambda df: dict((r["leaf"], r["n"]) for r in df.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEAF_ROWS).collect())  # noqa: E731  at most a row for each leaf
    v_parts = {i: -(-n // LEAF_ROWS) for i, n in count(leaves).items()}
    q_parts = {i: -(-n // LEAF_ROWS) for i, n in count(seeks).items()}
    parts = lambda held: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in held.items() for x in kv]), F.col("leaf")), F.lit(1)) if held else F.lit(1)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    x = leaves.select("id", "v", F.explode("leaves").alias("leaf")).withColumn("vpart", own(parts(v_parts))).withColumn("qpart", every(parts(q_parts)))
    q = seeks.select("id", "v", F.explode("leaves").alias("leaf")).withColumn("qpart", own(parts(q_parts))).withColumn("vpart", every(parts(v_parts)))
    columns = lambda df, kind: df.select("leaf", "vpart", "qpart", F.lit(kind).alias("kind"), "v", "id")
    met = columns(q, 0).unionByName(columns(x, 1)).repartition("leaf", "vpart", "qpart").sortWithinPartitions("leaf", "vpart", "qpart", "kind", "id")
    best = met.mapInArrow(_reranker(k), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
