"""Boosted trees over binned rows: one Spark job a level for the trees of all labels together.

The rows lie in memory as blocks of bytes, a bin each. A job sends back sums by label, node, feature and bin, tables of
fixed size for each of as many tasks as there are cores; the driver adds them up and chooses the splits. Loss, step,
leaves and shares of rows and features are those of Spark's ``GBTClassifier``, and the result is its model.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from furlong.sources.shared import Files, fresh_path

#: Bins are bytes; a row whose value is no number has the bin after the last.
MOST_BINS = 255
#: Rows of a block, rows from where on another task is worth it, and trees after which scores are written and their lineage ends.
BLOCK_ROWS, TASK_ROWS, WRITTEN_TREES = 65_536, 20_000, 25
_BLOCK = "id long, n int, x binary, y binary, w binary"


@dataclass(frozen=True)
class Shape:
    features: int
    bins: int
    labels: int
    depth: int = 4
    step: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    leaf_rows: float = 20
    seed: int = 42


@dataclass
class Tree:
    """Nodes from 1, the children of i are 2 i and 2 i + 1; rows go right whose bin is above the cut. A node without a split has the cut 255, and what comes below it its value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    total: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 << depth
        return Tree(np.zeros(n, np.int64), np.full(n, MOST_BINS, np.uint8), np.zeros(n), np.zeros(n))

    def nodes(self, x: np.ndarray, depth: int) -> np.ndarray:
        """Each row's node at a depth; ``x`` has a line of bins for each feature."""
        n = x.shape[1]
        flat, row, node = x.reshape(-1), np.arange(n), np.ones(n, np.int64)
        for _ in range(depth):
            node = 2 * node + (flat.take(self.feature.take(node) * n + row) > self.cut.take(node))
        return node


def _blocks(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, n, k = TaskContext.get().partitionId() << 32, [], 0, 0

        def block() -> pa.RecordBatch:
            column = lambda i, kind: np.concatenate([b.column(i).to_numpy(zero_copy_only=False).astype(kind) for b in held])
            x = np.stack([column(i, np.uint8) for i in range(shape.features)])
            y = np.stack([column(shape.features + i, np.uint8) for i in range(shape.labels)])
            cells = [x.tobytes(), y.tobytes(), column(shape.features + shape.labels, np.int64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([first + k], pa.int64()), pa.array([n], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], names=["id", "n", "x", "y", "w"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                held, n, k = [], 0, k + 1
        if n:
            yield block()

    return run


Block = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _opened(row: Row, shape: Shape) -> Block:
    """A block's number, bins and labels (a line for each), rows by cell, and scores by label."""
    of = lambda c, kind: np.frombuffer(row[c], kind)
    return row["id"], of("x", np.uint8).reshape(shape.features, -1), of("y", np.uint8).reshape(shape.labels, -1), of("w", np.int64), np.zeros((shape.labels, row["n"]))


def _sums(shape: Shape, round_: int, level: int, trees: list[Tree]) -> Callable[[Iterator[Block]], Iterator[np.ndarray]]:
    """Rows of the tree's sample and their residuals' sum by label, feature, node of the level and bin."""

    def run(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
        size = shape.bins << level
        out = np.zeros((shape.labels, shape.features, size, 2))
        for key, x, y, w, f in blocks:
            rng = np.random.default_rng([shape.seed, round_, key])
            kept = (rng.random(len(w)) < shape.rows).astype(np.float64) if w.max() == 1 else rng.binomial(w, shape.rows).astype(np.float64)
            for k, tree in enumerate(trees):
                sign = 2.0 * y[k] - 1.0
                rest = kept * (4.0 * sign / (1.0 + np.exp(2.0 * sign * f[k])) if round_ else sign)
                base = (tree.nodes(x, level) - (1 << level)) * shape.bins
                for j in range(shape.features):
                    at = base + x[j]
                    out[k, j, :, 0] += np.bincount(at, kept, size)
                    out[k, j, :, 1] += np.bincount(at, rest, size)
        yield out

    return run


def _scored(shape: Shape, weight: float, trees: list[Tree]) -> Callable[[Block], Block]:
    """A block with a tree's values added to its scores."""

    def run(block: Block) -> Block:
        key, x, y, w, f = block
        return key, x, y, w, np.stack([f[k] + weight * tree.value.take(tree.nodes(x, shape.depth)) for k, tree in enumerate(trees)])

    return run


def _grow(tree: Tree, shape: Shape, level: int, sums: np.ndarray, rng: np.random.Generator) -> bool:
    """Splits the nodes of a level by the most gain among a share of the features, as long as both sides keep enough rows; whether any was split."""
    by = sums.reshape(shape.features, 1 << level, shape.bins, 2)
    grown, tried = False, max(1, int(np.ceil(shape.columns * shape.features)))
    for i in range(1 << level):
        node = (1 << level) + i
        n, total = by[0, i].sum(axis=0)
        columns = np.sort(rng.choice(shape.features, tried, replace=False))
        if level and tree.cut[node >> 1] == MOST_BINS:
            tree.value[node] = tree.value[node >> 1]
            continue
        tree.total[node], tree.value[node] = n, total / n if n else 0.0
        left = by[columns, i, :-1].cumsum(axis=1)
        ln, lt = left[..., 0], left[..., 1]
        rn, rt = n - ln, total - lt
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((ln >= shape.leaf_rows) & (rn >= shape.leaf_rows), lt * lt / ln + rt * rt / rn - total * total / n, -1.0)
        j, cut = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[j, cut] > 1e-12 * n:
            tree.feature[node], tree.cut[node], grown = columns[j], cut, True
            for child, cn, ct in ((2 * node, ln[j, cut], lt[j, cut]), (2 * node + 1, rn[j, cut], rt[j, cut])):
                tree.total[child], tree.value[child] = cn, ct / cn
    return grown


def _filled(tree: Tree, depth: int) -> None:
    """What lies below a node without a split has its value."""
    for node in range(1, 1 << depth):
        if tree.cut[node] == MOST_BINS:
            tree.value[2 * node] = tree.value[2 * node + 1] = tree.value[node]


def boosted(rows: DataFrame, inputs: list[str], labels: list[str], weight: str, bins: int, trees: int, leaf_rows: float = 20) -> dict[str, GBTClassificationModel]:
    """A model for each label (0 or 1) of rows whose ``inputs`` are bins from 0 to below ``bins``; ``weight`` is the number of rows that one stands for.

    The order of the rows within a task is that of all columns, so the same rows give the same trees.
    """
    if bins > MOST_BINS:
        raise ValueError(f"{bins} bins; at most {MOST_BINS}")
    spark, shape = rows.sparkSession, Shape(len(inputs), bins, len(labels), leaf_rows=leaf_rows)
    slim = rows.select(*[F.col(c).cast("short") for c in inputs], *[F.col(c).cast("short") for c in labels], F.col(weight).cast("long").alias("__w"))
    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-slim.count() // TASK_ROWS)))
    slim = slim.repartition(parts, *slim.columns).sortWithinPartitions(*slim.columns)
    held = slim.mapInArrow(_blocks(shape), _BLOCK).rdd.map(lambda row: _opened(row, shape)).persist(StorageLevel.MEMORY_AND_DISK)
    rng, grown, written, last = np.random.default_rng(shape.seed), [], None, None
    for round_ in range(trees):
        now = [Tree.empty(shape.depth) for _ in labels]
        for level in range(shape.depth):
            sums = sum(held.mapPartitions(_sums(shape, round_, level, now)).collect())
            if last is not None:  # the new scores are in memory
                last.unpersist()
                last = None
            if not any([_grow(t, shape, level, sums[k], rng) for k, t in enumerate(now)]):
                break
        for t in now:
            _filled(t, shape.depth)
        grown.append(now)
        if round_ + 1 == trees:
            break
        new = held.map(_scored(shape, shape.step if round_ else 1.0, now))
        if (round_ + 1) % WRITTEN_TREES == 0:
            path = fresh_path(spark, "scores")
            new.saveAsPickleFile(path, batchSize=1)
            new = spark.sparkContext.pickleFile(path, parts)
            held.unpersist()
            if written:
                Files(spark, written).delete("")
            written = path
        last, held = held, new.persist(StorageLevel.MEMORY_AND_DISK)
    held.unpersist()
    if written:
        Files(spark, written).delete("")
    with ThreadPool(len(labels)) as pool:
        return dict(zip(labels, pool.map(lambda k: _model(spark, shape, [now[k] for now in grown], labels[k]), range(len(labels))), strict=True))


_NODE = "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: long, gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"


def _lines(number: int, tree: Tree) -> list[tuple]:
    """A tree's nodes, each before those below it."""
    out: list[tuple] = []

    def add(node: int) -> int:
        at, n, value = len(out), float(tree.total[node]), float(tree.value[node])
        out.append(())
        split = tree.cut[node] < MOST_BINS
        left, right = (add(2 * node), add(2 * node + 1)) if split else (-1, -1)
        how = (int(tree.feature[node]), [float(tree.cut[node]) + 0.5], -1) if split else (-1, [], -1)
        out[at] = (number, (at, value, 0.0, [n, n * value, n * value * value], int(n), 0.0 if split else -1.0, left, right, how))
        return at

    add(1)
    return out


def _model(spark: SparkSession, shape: Shape, trees: list[Tree], label: str) -> GBTClassificationModel:
    """The trees in the form in which Spark saves its models, read back as one; a feature's value is its bin."""
    path = fresh_path(spark, "trees")

    def about(kind: str, name: str, **more: object) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": f"{name}_{uuid.uuid4().hex[:12]}", "paramMap": {"labelCol": label, "maxDepth": shape.depth, "seed": shape.seed}, "defaultParamMap": {"featuresCol": "features", "predictionCol": "prediction", "impurity": "variance"}, **more})

    told = {"numFeatures": shape.features, "numTrees": len(trees)}
    whole = json.loads(about("classification.GBTClassificationModel", "GBTClassifier", **told))
    whole["paramMap"] |= {"maxIter": len(trees), "stepSize": shape.step, "subsamplingRate": shape.rows, "featureSubsetStrategy": str(shape.columns)}
    whole["defaultParamMap"] |= {"probabilityCol": "probability", "rawPredictionCol": "rawPrediction"}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, about("regression.DecisionTreeRegressionModel", "dtr"), shape.step if i else 1.0) for i in range(len(trees))], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([line for i, tree in enumerate(trees) for line in _lines(i, tree)], _NODE).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
