"""Operator 6: near-duplicate embeddings by hierarchical navigable small-world graphs, one for each shard.

Vectors are dealt to shards of at most about ``SHARD_ROWS`` by a hash of their
id, at least ``MIN_SHARDS``; each shard builds its own graph.  Every vector is
a query to every shard, in blocks.  A search holds a beam; the beam's width
starts at ``BEAM`` and doubles until at least ``RECALL`` of the links of ``PLANTED``
queries made for the shard are found.  ``AUDIT`` queries spread over each block are then compared
with the whole shard; where the links found fall below ``RECALL`` the beam doubles again, and
a shard that had searched with a narrower beam is searched once more.  A query whose beam is full of
links may have more of them than the beam holds: it is compared with the whole shard
instead, so there is no cap on partners.  Every link's cosine is computed in double precision
from the original vectors.  A task sends on link counts and a spanning forest of its links,
never all pairs of a group; components are then found from the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm._graph import components
from furlong.llm._shared import stored

SHARD_ROWS = 50_000
MIN_SHARDS = 6
LINKS = 12
BUILD_BEAM = 40
BEAM = 24
AUDIT = 64
PLANTED = 256
RECALL = 0.99
QUERY_ROWS = 1024
THRESHOLD = 0.9


class Hnsw:
    """A navigable small-world graph with layers, over unit vectors; nodes are inserted in batches."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.x = vectors.astype(np.float32)
        n = len(self.x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(LINKS)).astype(int), 6)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # (nodes, adjacency over their places), lowest first
        self._entries: list[np.ndarray] = []
        for lv in range(self.level.max() + 1 if n else 0):
            nodes = np.flatnonzero(self.level >= lv)
            self.layers.append((nodes, np.full((len(nodes), LINKS * (2 if lv == 0 else 1)), -1, np.int32)))
        for lv in range(len(self.layers) - 1, -1, -1):
            self._build(lv)

    def _build(self, lv: int) -> None:
        nodes, adjacency = self.layers[lv]
        x = self.x[nodes]
        n, width = adjacency.shape
        above = np.isin(nodes, self.layers[lv + 1][0]) if lv + 1 < len(self.layers) else np.zeros(n, bool)
        order = np.concatenate([np.flatnonzero(above), np.flatnonzero(~above)])  # those of the layer above come first
        done = 0
        while done < n:
            batch = order[done : done + max(1, min(512, done if done else 1))]
            old = order[:done]
            k = min(BUILD_BEAM, done)
            if done <= 1024:
                sim = x[batch] @ x[old].T if done else np.zeros((len(batch), 0), np.float32)
                near = np.argsort(-sim, 1)[:, :k]
                ids, sims = old[near], np.take_along_axis(sim, near, 1)
            else:
                ids, sims = self._beam(x, adjacency, x[batch], self._start(lv, x, x[batch], order[:done]), BUILD_BEAM)
            own = x[batch] @ x[batch].T
            own[np.triu_indices(len(batch))] = -2  # only those before it in the batch
            m = min(len(batch), 16)
            near = np.argsort(-own, 1)[:, :m]
            ids = np.concatenate([ids, batch[near]], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], 1)
            ids = np.where(sims > -1.5, ids, -1)
            chosen = self._diverse(x, ids, sims, LINKS)
            adjacency[batch, : chosen.shape[1]] = chosen
            self._back(x, adjacency, batch, chosen)
            done += len(batch)

    def _start(self, lv: int, x: np.ndarray, queries: np.ndarray, present: np.ndarray) -> np.ndarray:
        """Places in layer lv from which to search: nearest nodes of the layer above, else a few that are there."""
        if lv + 1 < len(self.layers):
            nodes = self.layers[lv + 1][0]
            top = self._descend(queries, lv + 1)
            return np.searchsorted(self.layers[lv][0], nodes[top])
        return np.broadcast_to(present[:4], (len(queries), min(4, len(present))))

    def _descend(self, queries: np.ndarray, lv: int) -> np.ndarray:
        """The few nearest places of layer lv for each query."""
        nodes, adjacency = self.layers[lv]
        x = self.x[nodes]
        if len(nodes) <= 512:
            sim = queries @ x.T
            return np.argsort(-sim, 1)[:, :4]
        start = self._start(lv, x, queries, np.arange(len(nodes)))
        ids, _ = self._beam(x, adjacency, queries, start, 8)
        return ids[:, :4]

    @staticmethod
    def _beam(x: np.ndarray, adjacency: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries side by side: (places, similarities), best first; -1 where there is none."""
        q, n = len(queries), len(x)
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, n + 1), bool)
        ids = np.full((q, width), -1, np.int64)
        sims = np.full((q, width), -2, np.float32)
        s = np.sort(start[:, :width], 1)
        s = np.where(np.concatenate([np.ones((q, 1), bool), s[:, 1:] != s[:, :-1]], 1) & (s >= 0), s, -1)
        ids[:, : s.shape[1]] = s
        sims[:, : s.shape[1]] = np.where(s >= 0, np.einsum("qkd,qd->qk", x[s], queries), -2)
        seen[rows, s] = True
        open_ = ids >= 0
        while True:
            best = np.where(open_, sims, -3).argmax(1)
            live = np.flatnonzero(open_[np.arange(q), best])
            if not len(live):
                break
            at = best[live]
            open_[live, at] = False
            nb = adjacency[ids[live, at]].astype(np.int64)
            fresh = (nb >= 0) & ~seen[live[:, None], nb]
            seen[live[:, None], np.where(fresh, nb, n)] = True
            nb = np.where(fresh, nb, -1)
            got = np.where(fresh, np.einsum("qkd,qd->qk", x[nb], queries[live]), -2).astype(np.float32)
            all_ids, all_sims = np.concatenate([ids[live], nb], 1), np.concatenate([sims[live], got], 1)
            all_open = np.concatenate([open_[live], fresh], 1)
            keep = np.argpartition(-all_sims, width - 1, 1)[:, :width]
            ids[live], sims[live], open_[live] = (np.take_along_axis(a, keep, 1) for a in (all_ids, all_sims, all_open))
        order = np.argsort(-sims, 1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    @staticmethod
    def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` neighbours, nearest first, each nearer to the node than to any chosen before; free places go to the nearest others."""
        order = np.argsort(-np.where(ids >= 0, sims, -3), 1)[:, : max(most, min(ids.shape[1], 48))]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        b, k = ids.shape
        if not k:
            return np.full((b, most), -1, np.int32)
        v = x[ids]
        between = np.einsum("bkd,bjd->bkj", v, v)
        taken = np.zeros((b, k), bool)
        for j in range(k):
            closest = np.where(taken[:, :j], between[:, j, :j], -3).max(1) if j else np.full(b, -3)
            taken[:, j] = (ids[:, j] >= 0) & (sims[:, j] > closest) & (taken.sum(1) < most)
        rank = np.where(taken, 0, 1) + np.where(ids >= 0, 0, 2)
        order = np.argsort(rank, 1, kind="stable")[:, :most]
        return np.take_along_axis(ids, order, 1).astype(np.int32)

    def _back(self, x: np.ndarray, adjacency: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
        """Adds the links back from neighbours; a node with too many keeps a diverse choice."""
        source = np.repeat(batch, chosen.shape[1])
        target = chosen.ravel()
        ok = target >= 0
        source, target = source[ok], target[ok]
        if not len(source):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(nodes), count.max()), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(source)) - np.repeat(first, count)] = source
        every = np.concatenate([adjacency[nodes].astype(np.int64), extra], 1)
        for at in range(0, len(nodes), 512):
            part = slice(at, at + 512)
            ids = every[part]
            sims = np.where(ids >= 0, np.einsum("bkd,bd->bk", x[ids], x[nodes[part]]), -3)
            adjacency[nodes[part]] = self._diverse(x, ids, sims, adjacency.shape[1])

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        queries = queries.astype(np.float32)
        nodes, adjacency = self.layers[0]
        width = min(width, len(nodes))
        return self._beam(self.x, adjacency, queries, self._start(0, self.x, queries, np.arange(len(nodes))), width)


class _Forest:
    """Union-find over ids."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, a: int) -> int:
        parent = self.parent
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows of a and b, in double precision."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


class _Shard:
    """A shard's graph, its beam and what the audits have found; ``widened`` tells that earlier queries had a narrower beam."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, threshold: float, beam: int = 0):
        self.ids, self.vectors, self.threshold = ids, vectors, threshold
        self.unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        self.graph, self.beam = Hnsw(self.unit), beam or BEAM
        self.want = self.got = 0  # links of the queries audited at this beam, and those found
        self.searched = self.widened = False
        self._audit(self._planted(), None)
        self.want = self.got = 0

    def _planted(self) -> np.ndarray:
        """Queries with a link each: vectors of the shard turned as far as the threshold allows, so that links are there however few the table has."""
        rng = np.random.default_rng(11)
        x = self.unit[rng.choice(len(self.unit), min(PLANTED, len(self.unit)), replace=False)]
        away = rng.standard_normal(x.shape)
        away -= np.einsum("ij,ij->i", away, x)[:, None] * x
        away /= np.maximum(np.sqrt(np.einsum("ij,ij->i", away, away)), 1e-9)[:, None]
        t = min(1.0, max(self.threshold, 0.0) + 1e-6)
        turned = t * x + np.sqrt(1 - t * t) * away
        return turned / np.sqrt(np.einsum("ij,ij->i", turned, turned))[:, None]

    def _whole(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place) near the threshold or above it, from the whole shard."""
        q, p = [], []
        for at in range(0, len(self.unit), 8192):
            a, b = np.nonzero(unit @ self.unit[at : at + 8192].T >= self.threshold - 1e-6)
            q.append(a)
            p.append(b + at)
        return np.concatenate(q), np.concatenate(p)

    def _found(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sims = self.graph.search(unit, self.beam)
        near = (ids >= 0) & (sims >= self.threshold - 1e-4)
        q, k = np.nonzero(near)
        return q, ids[q, k], np.flatnonzero(near.all(1))

    def _audit(self, unit: np.ndarray, ids: np.ndarray | None) -> None:
        """Widens the beam until ``RECALL`` of the links audited at it, these queries' among them, are found; a vector's hit on itself is no link."""
        n = len(self.ids)
        if self.beam >= n:
            return
        q, p = self._whole(unit)
        if ids is not None:
            other = ids[q] != self.ids[p]
            q, p = q[other], p[other]
        while len(q) and self.beam < n:
            fq, fp, full = self._found(unit)
            got = int((np.isin(q * n + p, fq * n + fp) | np.isin(q, full)).sum())
            if self.got + got >= RECALL * (self.want + len(q)):
                self.want, self.got = self.want + len(q), self.got + got
                return
            self.beam *= 2
            self.want = self.got = 0
            self.widened = self.widened or self.searched

    def links(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all links found, verified."""
        unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        spread = np.unique(np.linspace(0, len(ids) - 1, AUDIT).astype(int))
        self._audit(unit[spread], ids[spread])
        self.searched = True
        if self.beam < len(self.ids):
            q, p, full = self._found(unit)
        else:  # a search this wide costs more than the comparison
            q, p, full = np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(ids))
        if len(full):
            inside = ~np.isin(q, full)
            for at in range(0, len(full), 256):
                fq, fp = self._whole(unit[full[at : at + 256]])
                q, p, inside = np.concatenate([q, full[at + fq]]), np.concatenate([p, fp]), np.concatenate([inside, np.ones(len(fq), bool)])
            q, p = q[inside], p[inside]
        true = np.concatenate([cosines(vectors[q[at : at + 65536]], self.vectors[p[at : at + 65536]]) >= self.threshold for at in range(0, len(q), 65536)] or [np.zeros(0, bool)])
        other = ids[q] != self.ids[p]
        return q[true & other], p[true & other]


FOUND = "a long, b long, n long, shard int, beam int"


def _result(shard: int, a: list, b: list, n: list, beam: int | None = None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((a, b, n, [shard] * len(a), [beam] * len(a)), kinds, strict=True)], names=["a", "b", "n", "shard", "beam"])


def _searcher(dimension: int, threshold: float, beams: dict[int, int]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by shard and part: the shard's vectors (kind 0), then query blocks (kind 1).

        Out come links, and for a shard whose beam was widened after its first search a row with the last beam.
        """
        at, shard, held = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key != at:
                    if shard is not None and shard.widened:
                        yield _result(at[0], [None], [None], [None], shard.beam)
                    at, shard, held = key, None, []
                ids = np.frombuffer(batch.column(3)[i].as_buffer(), np.int64)
                vectors = np.frombuffer(batch.column(4)[i].as_buffer(), np.float64).reshape(len(ids), dimension)
                if batch.column(2)[i].as_py() == 0:
                    held.append((ids.copy(), vectors.copy()))
                    continue
                if shard is None:
                    if not held:
                        continue
                    shard = _Shard(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), threshold, beams.get(key[0], 0))
                    held = []
                q, p = shard.links(ids, vectors)
                n = np.bincount(q, minlength=len(ids))
                linked = np.flatnonzero(n)
                forest = _Forest()
                edges = [(a, b) for a, b in zip(ids[q].tolist(), shard.ids[p].tolist(), strict=True) if forest.join(a, b)]
                total = len(linked) + len(edges)
                yield _result(key[0], ids[linked].tolist() + [e[0] for e in edges], [None] * len(linked) + [e[1] for e in edges], n[linked].tolist() + [None] * (total - len(linked)))
        if shard is not None and shard.widened:
            yield _result(at[0], [None], [None], [None], shard.beam)

    return search


def _packer(dimension: int, rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Valid vectors in blocks by shard: (shard, ids, vectors)."""
        held: dict[int, list] = {}

        def out(shard: int) -> pa.RecordBatch:
            part = held.pop(shard)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.array([x[0] for x in part], np.int64).tobytes()], pa.binary()), pa.array([np.stack([x[1] for x in part]).tobytes()], pa.binary())], names=["shard", "ids", "vectors"])

        for batch in batches:
            for shard, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held.setdefault(shard, []).append((i, v.values.to_numpy(zero_copy_only=False)))
                if len(held[shard]) >= rows:
                    yield out(shard)
        for shard in list(held):
            yield out(shard)

    return pack


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors that are neither null, empty nor zero and hold finite components only, in double precision."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(v.isNotNull() & (F.size(v) > 0)).filter(F.coalesce(finite, F.lit(False))).filter(F.exists(v, lambda x: x != 0))


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id_col``, n_links (other vectors of cosine >= threshold), component_id (smallest id reachable by links), kept (the id is its component's).

    Vectors that are null, empty or zero, or hold null or non-finite components,
    and vectors of null id or of another length than the most usual, link with nothing
    and are their own component.  Repeated ids are one vector, the first in
    order.  Extra columns are ignored; an empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"))
    valid = valid_vectors(vectors, id_col, vector_col).filter("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    valid = stored(valid, "vectors")
    usual = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    d, n = usual["d"], usual["count"]
    shards = max(MIN_SHARDS, -(-n // SHARD_ROWS))
    dealt = valid.filter(F.size("v") == d).select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "v")
    blocks = stored(dealt.mapInArrow(_packer(d, QUERY_ROWS), "shard int, ids binary, vectors binary"), "blocks")
    parts = 1
    base = blocks.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "ids", "vectors")
    asks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "ids", "vectors")
    met = base.unionByName(asks).repartitionByRange(shards * parts, "shard", "part").sortWithinPartitions("shard", "part", "kind", F.xxhash64("ids"))
    found, beams = None, {}
    while True:
        run = stored(met.mapInArrow(_searcher(d, threshold, beams), FOUND), "found")
        wider = {r["shard"]: r["beam"] for r in run.filter("beam is not null").groupBy("shard").agg(F.max("beam").alias("beam")).collect()}  # a row a shard at most
        settled = run.filter("beam is null").filter(~F.col("shard").isin(list(wider)))
        found = settled if found is None else found.unionByName(settled)
        if not wider:
            break
        beams = beams | wider
        met = met.filter(F.col("shard").isin(list(wider)))
    counts = found.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    roots = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    out = rows.join(counts, "id", "left").join(stored(roots, "roots"), "id", "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
