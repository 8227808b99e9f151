"""Operator 4: exact n-gram Jaccard self-join of texts through prefix tries.

Two texts link when ``100 * |A n B| >= 80 * |A u B|`` over their distinct
five-word shingles.  The result is a row per input row with its class, not the
pairs; no link between different texts is lost.

1. One pass hashes every text's shingles into a set, keys the set by 64 bits
   (equal sets are one node), and counts all shingles into a table of fixed
   size, ``ORDER_BUCKETS`` counters.  The counters only give the global order:
   rare shingles first, ties by hash.  Any order is right; a good one is fast.
2. Texts that link share a shingle among the first ``n - ceil(0.8 n) + 1`` of
   either's order.  A second pass posts these in blobs by bucket, once for each
   key and task; postings whose shingle no second key has vanish where they
   meet.  A shingle whose counter is ``HOT_SHARE`` times the mean and more than
   ``HOT`` is spread over several buckets.  Counters are shared, so this is an
   upper bound of a shingle's own count; as the mean grows with the corpus, at
   most one counter in ``HOT_SHARE`` can be that high, at any size.
3. In each group of shingle and size band, every key is joined to a centre, one
   such edge for each key and turn.  Those edges are verified; most members of a
   large group of near copies fall into one component here, at linear cost.
4. Pairs that still lie in different components, share a prefix shingle and
   pass the length and position bounds are all verified.  None is dropped.

Verification stores the members of a block (a centre's members, or those of a
component) in a radix trie by the global order reversed (frequent first).  All probes
of the block descend that one trie; each keeps the overlap of a shared prefix for
everything below it, and prunes a subtree when the overlap so far plus what can remain
is too little for its shortest set.  A block is dealt out in parts of about ``BLOCK``
members or ``BLOCK_ITEMS`` shingles, so memory doesn't follow the group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.llm import _bloom
from furlong.llm._graph import components
from furlong.llm._shared import dropped, lean, small_batches, stored
from furlong.llm._text import mix, shingle_sets

ORDER_BUCKETS = 1 << 20
_SLICE = 1 << 14
BLOCK = 64
BLOCK_ITEMS = 1 << 20
BLOCK_PROBES = 1 << 14
HOT = 1 << 12
HOT_SHARE = 8
POST_ROWS = 1 << 20


def needed(x: int, y: int) -> int:
    """The least overlap of sets of x and y elements whose Jaccard similarity is 0.8 or more."""
    return -(-4 * (x + y) // 9)


def set_key(s: np.ndarray) -> int:
    """A 64-bit key of a set, as a signed integer; equal sets have equal keys."""
    return int(mix(mix(s).sum(dtype=np.uint64).reshape(1) + np.uint64(len(s))).astype(np.int64)[0])


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - ORDER_BUCKETS.bit_length() + 1)).astype(np.int64)


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


# --- passes over the texts -------------------------------------------------


@lean("ngram_join")
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row's id, text's hash, set size, key) of each text, then this task's counters in slices."""
    counts = np.zeros(ORDER_BUCKETS, np.uint32)
    names = ["id", "h", "n", "key", "slice", "counts"]
    for batch in batches:
        n, keys = [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            keys.append(set_key(s) if len(s) else None)
            np.add.at(counts, _bucket(s), 1)
        rows = len(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
    used = [k for k in range(ORDER_BUCKETS // _SLICE) if counts[k * _SLICE : (k + 1) * _SLICE].any()]
    if used:
        blobs = [zlib.compress(counts[k * _SLICE : (k + 1) * _SLICE].tobytes(), 1) for k in used]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(used), pa.int64())] * 4, pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=names)


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counters by slice; a task holds one array for each slice it owns."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64)
            sums[k] = sums[k] + x if k in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])


def _ordered(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set in the global order: rare first, ties by hash (s is sorted by hash)."""
    return s[np.argsort(counts[_bucket(s)], kind="stable")]


def hot_from(counts: np.ndarray) -> int:
    """The counter from which shingles are spread over several buckets."""
    return int(max(HOT, HOT_SHARE * counts.sum() / len(counts)))


_POSTS = "bucket int, keys binary, sizes binary, reps binary, tokens binary, places binary, spread binary"


def _poster(shared, buckets: int):
    @lean("ngram_join")
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Prefix shingles in blobs by bucket: keys with their sizes and numbers of shingles, then the shingles' low 48 bits, places and whether they are spread."""
        counts = shared.value
        hot, seen = hot_from(counts), set()
        held: list[tuple[np.ndarray, int, int]] = []
        n = 0

        def out() -> pa.RecordBatch:
            token = np.concatenate([t for t, _, _ in held])
            sizes = [len(t) for t, _, _ in held]
            row = np.repeat(np.arange(len(held)), sizes)
            key, size = np.array([k for _, k, _ in held], np.int64), np.array([m for _, _, m in held], np.uint32)
            place = np.concatenate([np.arange(m, dtype=np.uint32) for m in sizes])
            share = (counts[_bucket(token)] // hot + 1).astype(np.uint64)
            salt = mix(key.view(np.uint64))[row] % share
            bucket = (mix(token + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # within a bucket by row
            token, row, place, spread, bucket = token[order], row[order], place[order], share[order] > 1, bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
            columns: list[list] = [[] for _ in range(7)]
            for x in range(buckets):
                i, j = cut[x], cut[x + 1]
                if i < j:
                    rows, reps = np.unique(row[i:j], return_counts=True)
                    low = np.ascontiguousarray(token[i:j].view(np.uint8).reshape(-1, 8)[:, :6])
                    for column, value in zip(columns, (x, key[rows].tobytes(), size[rows].tobytes(), reps.astype(np.uint32).tobytes(), low.tobytes(), place[i:j].tobytes(), np.packbits(spread[i:j]).tobytes()), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["bucket", "keys", "sizes", "reps", "tokens", "places", "spread"])

        for batch in batches:
            for s in shingle_sets(batch.column(0)):
                if not len(s) or (k := set_key(s)) in seen:
                    continue
                seen.add(k)
                if len(seen) > 1 << 18:
                    seen.clear()
                first = _ordered(s, counts)[: prefix_length(len(s))]
                held.append((first, k, len(s)))
                n += len(first)
                if n >= POST_ROWS:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return post


@lean("ngram_join")
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's postings, those whose shingle another key has; equal ones once.  A bucket holds about ``POST_ROWS`` of them.

    A spread shingle is kept whole, for its other keys may be in another bucket.
    Shingles are told apart by 48 bits here; a mix-up only adds pairs to verify.
    """
    names = ["token", "key", "n", "place"]

    def out(held: list[dict]) -> Iterator[pa.RecordBatch]:
        reps = [np.frombuffer(r["reps"], np.uint32) for r in held]
        low = np.frombuffer(b"".join(r["tokens"] for r in held), np.uint8).reshape(-1, 6)
        token = np.zeros((len(low), 8), np.uint8)
        token[:, :6] = low
        token = token.view(np.int64).ravel()
        key = np.concatenate([np.repeat(np.frombuffer(r["keys"], np.int64), c) for r, c in zip(held, reps, strict=True)])
        size = np.concatenate([np.repeat(np.frombuffer(r["sizes"], np.uint32), c) for r, c in zip(held, reps, strict=True)])
        place = np.frombuffer(b"".join(r["places"] for r in held), np.uint32)
        spread = np.concatenate([np.unpackbits(np.frombuffer(r["spread"], np.uint8), count=int(c.sum())) for r, c in zip(held, reps, strict=True)]).astype(bool)
        order = np.lexsort((key, token))
        t, k = token[order], key[order]
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        order = order[fresh]
        t = t[fresh]
        same = t[1:] == t[:-1]
        met = spread[order]
        met[1:] |= same
        met[:-1] |= same
        order = order[met]
        for at in range(0, len(order), 1 << 16):
            i = order[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(token[i]), pa.array(key[i]), pa.array(size[i].astype(np.int32)), pa.array(place[i].astype(np.int32))], names=names)

    at, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != at:
                if held:
                    yield from out(held)
                at, held = r["bucket"], []
            held.append(r)
    if held:
        yield from out(held)


def _stamp(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(-1).to_numpy()


def _sets_of(shared, wanted):
    @lean("ngram_join")
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ordered sets of rows that the Bloom filter passes, frequent shingles first; equal rows of a task once."""
        counts, bits = shared.value, wanted.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = _stamp(batch.column(0))
            found, blobs, held = [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64()), pa.array(blobs, pa.binary())], names=["key", "id", "items"])

            for row, s in enumerate(shingle_sets(batch.column(1))):
                if not len(s):
                    continue
                k, i = set_key(s), int(ids[row])
                if (k, i) in seen or not _bloom.may_hold(bits, np.array([k]), np.array([i]))[0]:
                    continue
                if len(seen) > 1 << 18:
                    seen.clear()
                seen.add((k, i))
                found.append((k, i))
                blobs.append(_ordered(s, counts)[::-1].tobytes())
                held += len(blobs[-1])
                if held > 1 << 23:
                    yield out()
                    found, blobs, held = [], [], 0
            if found:
                yield out()

    return sets


# --- the trie --------------------------------------------------------------


class _Node:
    __slots__ = ("children", "ends", "least", "most", "run")

    def __init__(self, run: np.ndarray, least: int, most: int):
        self.run, self.least, self.most = run, least, most
        self.children: dict[int, _Node] = {}
        self.ends: list[int] = []


class SetTrie:
    """A radix trie of globally ordered sets.

    ``add`` stores a set; ``within`` returns the stored sets whose Jaccard
    similarity to a probe, ordered alike, is 0.8 or more.
    """

    def __init__(self):
        self.root = _Node(np.zeros(0, np.uint64), 1 << 60, 0)

    def add(self, name: int, items: np.ndarray) -> None:
        n, at, node = len(items), 0, self.root
        node.least, node.most = min(node.least, n), max(node.most, n)
        while at < n:
            child = node.children.get(int(items[at]))
            if child is None:
                child = _Node(items[at:], n, n)
                node.children[int(items[at])] = child
                node, at = child, n
                break
            m = min(len(child.run), n - at)
            differ = np.flatnonzero(child.run[:m] != items[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.run):  # split the run
                upper = _Node(child.run[:same], child.least, child.most)
                child.run = child.run[same:]
                upper.children[int(child.run[0])] = child
                node.children[int(items[at])] = upper
                child = upper
            child.least, child.most = min(child.least, n), max(child.most, n)
            node, at = child, at + same
        node.ends.append(name)

    def within(self, probe: np.ndarray) -> list[int]:
        by_hash = np.argsort(probe)
        sorted_probe, n = probe[by_hash], len(probe)
        found: list[int] = []
        stack = [(self.root, 0, 0, 0)]  # node, depth above it, overlap above it, place in the probe after the last match
        while stack:
            node, depth, overlap, place = stack.pop()
            if len(node.run):
                i = np.minimum(np.searchsorted(sorted_probe, node.run), n - 1)
                hit = sorted_probe[i] == node.run
                got = int(hit.sum())
                if got:
                    overlap += got
                    place = max(place, int(by_hash[i[hit]].max()) + 1)
                depth += len(node.run)
            if overlap + min(node.most - depth, n - place) < needed(n, node.least):
                continue
            if node.ends and overlap >= needed(n, depth):
                found += node.ends
            stack += [(c, depth, overlap, place) for c in node.children.values()]
        return found


@lean("ngram_join")
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each part of a block; rows come as (block, salt, turn, probe, key, items), the members first (probe false): they fill the trie that all probes descend."""
    at, trie, last = None, SetTrie(), None
    a: list[int] = []
    b: list[int] = []

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a.clear()
        b.clear()
        return rows

    for batch in batches:
        for block, salt, turn, probe, key, items in zip(*[batch.column(c).to_pylist() for c in range(5)], batch.column(5), strict=True):
            if (block, salt, turn) != at:
                at, trie, last = (block, salt, turn), SetTrie(), None
            values = np.frombuffer(items.as_buffer(), np.uint64)
            if (probe, key) == last:
                continue
            last = (probe, key)
            if not probe:
                trie.add(key, values.copy())
            else:
                hits = [x for x in trie.within(values) if x != key]
                a.extend([key] * len(hits))
                b.extend(hits)
                if len(a) >= 1 << 16:
                    yield out()
    if a:
        yield out()


def _links(pairs: DataFrame, sets: DataFrame, stands: DataFrame) -> DataFrame:
    """The verified pairs of ``pairs`` (block, probe, member, n): members of a block are dealt to parts of about ``BLOCK`` of them (n shingles
    each), and a probe goes to the parts that hold members of its pairs; a part's probes are dealt out, too, if they are many."""
    members = pairs.select("block", "member", "n").distinct()
    size = members.groupBy("block").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_ITEMS)).alias("share"))
    part = F.pmod(F.xxhash64("member"), "share").alias("salt")
    dealt = stored(pairs.join(size, "block").select("block", part, "probe", "member"), "dealt")
    turns = dealt.groupBy("block", "salt").agg(F.ceil(F.count(F.lit(1)) / BLOCK_PROBES).alias("turns"))
    turned = stored(dealt.join(turns, ["block", "salt"]).select("block", "salt", "probe", "member", "turns", F.pmod(F.xxhash64("probe", F.lit(1)), "turns").alias("turn")), "turned")
    inside = turned.select("block", "salt", "member", "turns").distinct().select("block", "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("probe"), F.col("member").alias("key"))
    asking = turned.select("block", "salt", "turn", F.lit(True).alias("probe"), F.col("probe").alias("key")).distinct()
    rows = inside.unionByName(asking).join(stands, "key").join(sets, ["key", "id"]).select("block", "salt", "turn", "probe", "key", "items")
    met = rows.repartition("block", "salt", "turn").sortWithinPartitions("block", "salt", "turn", "probe", "key")
    found = stored(met.mapInArrow(_verify, "a long, b long"), "links")
    dropped(dealt, turned)
    return found


def _fetch(texts: DataFrame, rows: DataFrame, keys: DataFrame, order) -> tuple[DataFrame, DataFrame]:
    """The ordered sets of ``keys`` (key, id, items), hashed anew from the one row that stands for each key, and those rows (key, id).

    A Bloom filter of (key, id) finds the rows; what it lets through by chance is left out by the exact join on both.
    """
    stands = stored(rows.join(keys, "key", "left_semi").groupBy("key").agg(F.coalesce(F.min("id"), F.lit(-1).cast("long")).alias("id")), "stands")
    wanted = texts.sparkSession.sparkContext.broadcast(_bloom.bloom(stands, stands.count()))
    return stored(texts.mapInArrow(_sets_of(order, wanted), "key long, id long, items binary"), "sets"), stands


_PREFIX = "(n - floor((4 * n + 4) / 5) + 1)"


def _reaches(nx: str, px: str, ny: str, py: str) -> str:
    """Whether sets of sizes nx and ny that share the shingle at px and py can link: what can be common before it and from it on."""
    return f"5 * least({nx}, {ny}) >= 4 * greatest({nx}, {ny}) and 9 * (least({px}, {py}) + least({nx} - {px}, {ny} - {py})) >= 4 * ({nx} + {ny})"


def _band(share: float = 0.0) -> Column:
    """The size band of a key: a factor of 1.25 each."""
    return F.floor(F.log("n") / F.lit(float(np.log(1.25))) + F.lit(share)).cast("int")


def _star(met: DataFrame) -> DataFrame:
    """(block, probe, member, n): for each key one edge to a centre, the one that it shares most shingles with; the block is the centre.

    A group's centre is the key that has the fewest shingles rarer than the group's: it is
    near the middle of its copies.  Keys in the last quarter of their size band join the next band's group, too,
    so that copies astride two bands come together.  This only saves work: what it leaves open is left to the exhaustive step.
    """
    banded = met.select("token", "key", "n", "place", F.explode(F.array_distinct(F.array(_band(), _band(0.25)))).alias("band"))
    centre = banded.groupBy("token", "band").agg(F.min_by(F.struct("key", "n", "place"), F.struct("place", "key")).alias("c"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    linked = banded.join(centre, ["token", "band"]).filter("key <> c.key").filter(_reaches("n", "place", "c.n", "c.place"))
    shared = linked.groupBy(F.col("key").alias("member"), F.col("c.key").alias("probe"), "band", "n").agg(F.count(F.lit(1)).alias("shared")).filter(f"4 * shared >= {_PREFIX}")
    best = shared.groupBy("member").agg(F.max_by(F.struct("probe", "n"), F.struct("shared", "probe")).alias("e"))
    return stored(best.select(F.col("e.probe").alias("block"), F.col("e.probe").alias("probe"), "member", F.col("e.n").alias("n")), "star")


def _open_pairs(tagged: DataFrame) -> DataFrame:
    """(block, probe, member, n): keys of different components that may link, judged at the first shingle that they share; the block is the member's component.

    From that shingle on, x can have ``n - place`` shingles in common with y.  If x's prefix ends before
    y's, those of its prefix that y's component doesn't post can't be among them (``rest``);
    which of the two ends first isn't known here, so the better case of the two counts.
    """
    by_place = Window.partitionBy("key").orderBy("place")
    after = F.count(F.lit(1)).over(Window.partitionBy("key")) - F.row_number().over(by_place)
    t = tagged.withColumn("rest", F.col("n") - F.col("place") - (F.expr(_PREFIX) - F.col("place") - 1 - after))
    x, y = t.alias("x"), t.alias("y")
    common = "greatest(least(x.rest, y.n - y.place), least(x.n - x.place, y.rest))"
    met = x.join(y, F.expr(f"x.token = y.token and x.key < y.key and x.root <> y.root and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) and 9 * {common} >= 4 * (x.n + y.n)"))
    return met.select(F.col("y.root").alias("block"), F.col("x.key").alias("probe"), F.col("y.key").alias("member"), F.col("y.n").alias("n")).distinct()


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_shingles (set size), component_id.

    component_id is the smallest non-null id reachable by links, the row's own
    included.  Words are lower-cased (A-Z) runs without white space; a text of
    one to four words has its whole sequence as its one shingle.  A null or
    wordless text has no shingle and links with nothing: its component is its
    own id.  Texts of any length count whole.  A row of null id is a node like any other, but never names a
    component unless no other id is there (then null).  Repeated rows come back
    as often as they came; which of equally good edges is tried first changes no result.  Extra columns are ignored, whatever their names.
    An empty table gives an empty table.
    """
    return rows_with_classes(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def text_hash(id_col: str, text_col: str) -> Column:
    """With the id, what tells rows of a table apart but for equal ones."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(text_col).cast("string"))


def rows_with_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, n, root, component_id) of every row: h is ``text_hash``, root the class (null for a text without words)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), text_hash(id_col, text_col).alias("h"))
    measured = stored(texts.mapInArrow(_measure, "id long, h long, n long, key long, slice int, counts binary"), "measured")
    slices = measured.filter("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(_add_slices, "slice int, counts binary")
    counts = np.zeros(ORDER_BUCKETS, np.int64)
    for row in slices.collect():  # ORDER_BUCKETS numbers, whatever the input
        counts[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(row["counts"], np.int64)
    order = spark.sparkContext.broadcast(counts)

    rows = measured.filter("slice is null").select("id", "h", "n", "key")
    texts = texts.select("id", "text")
    buckets = 64 * (1 + int(counts.sum()) // (5 * 64 * POST_ROWS))  # a fifth of the shingles is posted
    posted = texts.select("text").mapInArrow(_poster(order, buckets), _POSTS).repartition("bucket").sortWithinPartitions("bucket")
    met = stored(posted.mapInArrow(_met, "token long, key long, n int, place int"), "met")

    edges = _star(met)
    sets, stands = _fetch(texts, rows, edges.select(F.explode(F.array("probe", "member")).alias("key")), order)
    links = _links(edges, sets, stands)
    dropped(sets, stands, edges)
    parts = stored(components(links), "part").withColumnRenamed("node", "key")
    marked = stored(met.join(parts, "key", "left").select("token", "key", "n", "place", F.coalesce("root", "key").alias("root")), "marked")
    dropped(met)
    open_tokens = stored(marked.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token"), "open")
    tagged = stored(marked.join(open_tokens, "token", "left_semi"), "tagged")
    dropped(marked, open_tokens, parts)
    pairs = stored(_open_pairs(tagged), "pairs")
    dropped(tagged)
    sets, stands = _fetch(texts, rows, pairs.select(F.explode(F.array("probe", "member")).alias("key")), order)
    more = _links(pairs, sets, stands)
    dropped(sets, stands, pairs)
    every = stored(links.unionByName(more), "every")
    dropped(links, more)
    parts = stored(components(every), "parts").withColumnRenamed("node", "key")
    dropped(every)

    named = stored(rows.filter("key is not null").join(parts, "key", "left").select("id", "h", "n", F.coalesce("root", "key").alias("root")), "named")
    dropped(parts)
    lowest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = named.join(lowest, "root").select("id", "h", "n", "root", "component_id")
    alone = rows.filter("key is null").select("id", "h", "n", F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id"))
    out = stored(linked.unionByName(alone), "classes")
    dropped(named, measured)
    return out
