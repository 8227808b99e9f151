"""Operator 1: cross-entropy difference under matched n-gram models of a target and of the background.

Both models are bigram models over one vocabulary, all words of both corpora
and one class for words of neither,
smoothed alike: P(w | v) = (c(v, w) + KAPPA * P(w)) / (c(v) + KAPPA), with P(w)
from counts plus one.  A word's loss difference is log P_background - log
P_target; a document's score is the mean over its words, so a low score (below
zero) means that the document is more like the target.

Written as log(1 + c(v, w) / (KAPPA P(w))) and a rest that depends on v and w alone,
the rest of the ``FREQUENT`` most frequent words comes from a broadcast table of fixed size.
All else is met by hash bucket: documents post their pairs, and their other words, in blobs of a few bytes a pair;
the bucket's task gets the counts of these words, counts the pairs (the background's
from the posts themselves where it is the documents) and sends
back one sum a document.  Which words are frequent decides speed only: pairs of a
frequent second word are dealt out by both words, so that no bucket holds all of them; pairs of any other by
the second word, where its counts are.  Pairs are told apart by 63 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm._shared import dropped, small_batches, stored
from furlong.llm._text import mix, pieces, word_hashes

FREQUENT = 1 << 15
KAPPA = 100.0
CUTOFF = 1  # every counted pair is in the models
BUCKET_WORDS = 1 << 20
BATCH_BYTES = 8 << 20
_HELD = 1 << 22

_RARE = np.uint64(1 << 63)
_LOW = np.uint64((1 << 48) - 1)
_TOP = np.uint64(48)

#: Kinds of blobs: counts of other words, pairs of the target and of the background, posts of pairs and of other words, sums, and what a batch needs at the end.
WORDS, TARGET, BACKGROUND, PAIRS, OTHERS, SUMS, META = range(7)


class _Tally:
    """Counts of keys, combined whenever ``_HELD`` are held."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray) -> pa.RecordBatch | None:
        self.parts.append(keys)
        self.n += len(keys)
        return self.out() if self.n >= _HELD else None

    def out(self) -> pa.RecordBatch | None:
        if not self.n:
            return None
        keys, n = np.unique(np.concatenate(self.parts), return_counts=True)
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for batch in batches:
        for _lo, _hi, data, offsets in pieces(batch.column(0)):
            out = tally.add(word_hashes(data, offsets)[0])
            if out is not None:
                yield out
    out = tally.out()
    if out is not None:
        yield out


def _numbers(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Each word's place in the sorted vocabulary, or its length for any other word."""
    if not len(vocabulary):
        return np.zeros(len(words), np.int64)
    i = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[i] == words, i, len(vocabulary))


def _inner(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words have one before them in their text."""
    inner = np.ones(len(words), bool)
    inner[first[:-1][first[:-1] < len(words)]] = False
    return inner


def _place(words: np.ndarray) -> np.ndarray:
    """The part of a key that all pairs of an infrequent second word share."""
    return _RARE | (words >> np.uint64(49)) << _TOP


def _keys(words: np.ndarray, numbers: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Keys of the pairs that end at the given places: the number of a frequent second word, or a part of its hash, and 48 bits."""
    v, w, n = words[at - 1], words[at], numbers[at]
    return np.where(n < size, n.astype(np.uint64) << _TOP | v & _LOW, _place(w) | mix(v * np.uint64(0x9E3779B97F4A7C15) + w) & _LOW)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(np.where(keys & _RARE != 0, keys >> _TOP, keys)) % np.uint64(buckets)).astype(np.int64)


_BLOB = "bucket int, kind int, batch long, keys binary, counts binary, docs binary, sums binary"
_NAMES = [x.split()[0] for x in _BLOB.split(", ")]


def _blob(bucket: int, kind: int, batch: int, *blobs: bytes | None) -> dict:
    return dict(zip(_NAMES, (bucket, kind, batch, *blobs), strict=True))


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(_NAMES, kinds, strict=True)], names=_NAMES)


def _dealt(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that a sorted array holds."""
    cut = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
    return ((x, cut[x], cut[x + 1]) for x in range(buckets) if cut[x] < cut[x + 1])


def _pair_counter(shared, kind: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, tally = shared.value[0], _Tally()

        def rows(counted: pa.RecordBatch) -> pa.RecordBatch:
            keys, n = counted.column(0).to_numpy().view(np.uint64), counted.column(1).to_numpy()
            b = _bucket(keys, buckets)
            order = np.argsort(b, kind="stable")
            keys, n = keys[order], n[order]
            return _rows([_blob(x, kind, 0, keys[i:j].tobytes(), n[i:j].astype(np.uint32).tobytes(), None, None) for x, i, j in _dealt(b[order], buckets)])

        for batch in batches:
            for _lo, _hi, data, offsets in pieces(batch.column(0)):
                words, first = word_hashes(data, offsets)
                out = tally.add(_keys(words, _numbers(frequent, words), np.flatnonzero(_inner(words, first)), len(frequent)))
                if out is not None:
                    yield rows(out)
        out = tally.out()
        if out is not None:
            yield rows(out)

    return count


def _word_packer(shared, buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the words that aren't frequent, by bucket."""
        frequent, held, n = shared.value[0], [], 0

        def rows() -> pa.RecordBatch:
            w, t, b = map(np.concatenate, zip(*held, strict=True))
            x = _bucket(_place(w), buckets)
            order = np.argsort(x, kind="stable")
            w, t, b = w[order], t[order], b[order]
            return _rows([_blob(k, WORDS, 0, w[i:j].tobytes(), t[i:j].tobytes(), b[i:j].tobytes(), None) for k, i, j in _dealt(x[order], buckets)])

        for batch in batches:
            w, t, b = (batch.column(c).to_numpy() for c in range(3))
            other = _numbers(frequent, w.view(np.uint64)) == len(frequent)
            held.append((w.view(np.uint64)[other], t[other], b[other]))
            n += int(other.sum())
            if n >= _HELD >> 2:
                yield rows()
                held, n = [], 0
        if n:
            yield rows()

    return pack


def _poster(shared, buckets: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch of texts: its ids and what the frequent words alone give (META), and its pairs and other words by bucket."""
        frequent, by_word, by_context = shared.value[:3]
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids, base, length, pairs, others, held, n_docs = [], [], [], [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, base, length, pairs, others, held, n_docs, number
            if ids:
                yield _rows([_blob(-1, META, number, np.array([0 if i is None else i for i in ids], np.int64).tobytes(), np.concatenate(length).astype(np.int64).tobytes(), np.array([i is None for i in ids]).tobytes(), np.concatenate(base).tobytes())])
                narrow = np.uint16 if n_docs <= 1 << 16 else np.uint32
                k, d = map(np.concatenate, zip(*pairs, strict=True))
                b = _bucket(k, buckets)
                order = np.lexsort((k, b))
                k, d, b = k[order], d[order].astype(narrow), b[order]
                out = []
                for x, i, j in _dealt(b, buckets):
                    u, n = np.unique(k[i:j], return_counts=True)
                    out.append(_blob(x, PAIRS, number, u.tobytes(), n.astype(np.uint32).tobytes(), d[i:j].tobytes(), None))
                if out:
                    yield _rows(out)
                w, k, d, f = map(np.concatenate, zip(*others, strict=True))
                b = _bucket(_place(w), buckets)
                order = np.lexsort((w, b))
                w, k, d, f, b = w[order], k[order], d[order].astype(narrow), f[order], b[order]
                out = [_blob(x, OTHERS, number, w[i:j].tobytes(), k[i:j].tobytes(), d[i:j].tobytes(), f[i:j].tobytes()) for x, i, j in _dealt(b, buckets)]
                if out:
                    yield _rows(out)
                number += 1
            ids, base, length, pairs, others, held, n_docs = [], [], [], [], [], 0, 0

        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, data, offsets in pieces(batch.column(1)):
                words, first = word_hashes(data, offsets)
                w, inner = _numbers(frequent, words), _inner(words, first)
                at = np.flatnonzero(inner)
                value = by_word[w]
                value[at] += by_context[w[at - 1]]
                total = np.concatenate([[0.0], np.cumsum(value)])
                doc = np.repeat(np.arange(hi - lo), np.diff(first)) + n_docs
                keys = np.zeros(len(words), np.uint64)
                keys[at] = _keys(words, w, at, len(frequent))
                known, other = at[w[at] < len(frequent)], np.flatnonzero(w == len(frequent))
                pairs.append((keys[known], doc[known]))
                others.append((words[other], keys[other], doc[other], np.append(inner[1:], False)[other]))
                ids += names[lo:hi]
                base.append(total[first[1:]] - total[first[:-1]])
                length.append(np.diff(first))
                n_docs += hi - lo
                held += len(data)
                if held >= BATCH_BYTES or n_docs >= 1 << 15:
                    yield from flush()
        yield from flush()

    return post


class _Counts:
    """Sorted keys and their counts, looked up; an absent key has none."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        keys = np.concatenate([k for k, _ in parts] or [np.zeros(0, np.uint64)])
        n = np.concatenate([c for _, c in parts] or [np.zeros(0)])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order].astype(np.float64)
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
        self.keys, self.n = keys[start], np.add.reduceat(n, start) if len(start) else n

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.n[i], 0.0)


def _settler(shared, own: bool):
    """By bucket: counts first, then posts; out come sums by document of the batch.  ``own``: the posts are the background's pairs."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (pt, pb), (all_t, all_b) = shared.value[3:]
        at, held = None, {}

        def array(r: dict, name: str, kind) -> np.ndarray:
            return np.frombuffer(r[name], kind)

        def docs(r: dict, n: int) -> np.ndarray:
            return array(r, "docs", np.uint16 if len(r["docs"]) == 2 * n else np.uint32)

        def out() -> Iterator[pa.RecordBatch]:
            words = [(array(r, "keys", np.uint64), array(r, "counts", np.int64), array(r, "docs", np.int64)) for r in held.get(WORDS, [])]
            word_t, word_b = _Counts([(w, t) for w, t, _ in words]), _Counts([(w, b) for w, _, b in words])
            counted = lambda kind: [(array(r, "keys", np.uint64), array(r, "counts", np.uint32)) for r in held.get(kind, [])]
            background = counted(BACKGROUND)
            if own:
                background += counted(PAIRS)
                for r in held.get(OTHERS, []):
                    k = array(r, "counts", np.uint64)
                    k = k[k != 0]
                    background.append((k, np.ones(len(k), np.uint32)))
            pair_t, pair_b = _Counts(counted(TARGET)), _Counts(background)
            for r in held.get(PAIRS, []):
                u, n = array(r, "keys", np.uint64), array(r, "counts", np.uint32)
                w = (u >> _TOP).astype(np.int64)
                gain = np.log1p(pair_b(u) / (KAPPA * pb[w])) - np.log1p(pair_t(u) / (KAPPA * pt[w]))
                yield _rows([_blob(-1, SUMS, r["batch"], None, None, None, np.bincount(docs(r, int(n.sum())), np.repeat(gain, n)).tobytes())])
            for r in held.get(OTHERS, []):
                w, k, followed = array(r, "keys", np.uint64), array(r, "counts", np.uint64), array(r, "sums", bool)
                t, b = word_t(w), word_b(w)
                own_t, own_b = (t + 1) / all_t, (b + 1) / all_b
                value = np.log(own_b) - np.log(own_t) + followed * (np.log(t + KAPPA) - np.log(b + KAPPA))
                value += np.log1p(pair_b(k) / (KAPPA * own_b)) - np.log1p(pair_t(k) / (KAPPA * own_t))  # key 0, of a text's first word, has no count
                yield _rows([_blob(-1, SUMS, r["batch"], None, None, None, np.bincount(docs(r, len(w)), value).tobytes())])

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["kind"] == META:
                    yield _rows([r])
                    continue
                if r["bucket"] != at:
                    yield from out()
                    at, held = r["bucket"], {}
                held.setdefault(r["kind"], []).append(r)
        yield from out()

    return settle


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By batch: its ids (META) first, then the buckets' sums."""
    meta, total = None, None

    def out() -> pa.RecordBatch:
        ids, n, null = np.frombuffer(meta["keys"], np.int64), np.frombuffer(meta["counts"], np.int64), np.frombuffer(meta["docs"], bool)
        score = np.divide(total, n, out=np.zeros(len(n)), where=n > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(n), pa.array(score)], names=["id", "n_words", "score"])

    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == META:
                if meta is not None:
                    yield out()
                meta, total = r, np.frombuffer(r["sums"], np.float64).copy()
            else:
                sums = np.frombuffer(r["sums"], np.float64)
                total[: len(sums)] += sums
    if meta is not None:
        yield out()


def cross_entropy_difference(docs: DataFrame, target: DataFrame, background: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, score (mean loss under the target's model less that under the background's; below zero: more like the target).

    ``background`` is ``docs`` itself unless given.  A null or wordless text has
    n_words 0 and score 0.  Null and repeated ids are carried along, extra columns are
    ignored.  An empty target or background leaves its model uniform; an empty table of documents gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = lambda df: df.select(F.col(text_col).cast("string").alias("text"))
    corpora = {"t": text(target), "b": text(docs if background is None else background)}

    halves = [df.mapInArrow(_count_words, "key long, n long").select("key", F.when(F.lit(c == "t"), F.col("n")).otherwise(0).alias("t"), F.when(F.lit(c == "b"), F.col("n")).otherwise(0).alias("b")) for c, df in corpora.items()]
    words = stored(halves[0].unionByName(halves[1]).groupBy("key").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "words")
    total_t, total_b, size = words.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0)), F.count(F.lit(1))).first()
    top = words.orderBy((F.col("t") + F.col("b")).desc(), "key").limit(FREQUENT).collect()  # a table of fixed size
    known = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(known)
    known = known[order]
    ct, cb = (np.array([r[c] for r in top], float)[order] for c in "tb")
    all_t, all_b = total_t + size + 1, total_b + size + 1
    pt, pb = (ct + 1) / all_t, (cb + 1) / all_b
    # the loss difference but for the pairs' own counts: by the word, and by the word before it; other words' are met in their buckets
    by_word, by_context = np.append(np.log(pb) - np.log(pt), 0.0), np.append(np.log(ct + KAPPA) - np.log(cb + KAPPA), 0.0)
    shared = spark.sparkContext.broadcast((known, by_word, by_context, (pt, pb), (all_t, all_b)))
    n_words = total_t + total_b
    if background is not None:
        n_words += docs.agg(F.coalesce(F.sum(F.length(F.col(text_col).cast("string"))), F.lit(0))).first()[0] // 4
    buckets = 32 * (1 + n_words // (32 * BUCKET_WORDS))
    met = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_poster(shared, buckets), _BLOB)
    met = met.unionByName(words.mapInArrow(_word_packer(shared, buckets), _BLOB)).unionByName(corpora["t"].mapInArrow(_pair_counter(shared, TARGET, buckets), _BLOB))
    if background is not None:
        met = met.unionByName(corpora["b"].mapInArrow(_pair_counter(shared, BACKGROUND, buckets), _BLOB))
    met = met.repartition("bucket", F.when(F.col("kind") == META, F.col("batch"))).sortWithinPartitions("bucket", "kind")
    summed = met.mapInArrow(_settler(shared, background is None), _BLOB).repartition("batch").sortWithinPartitions("batch", F.desc("kind"))
    scored = stored(summed.mapInArrow(_finish, "id long, n_words long, score double"), "scores")
    dropped(words)
    return scored.withColumnRenamed("id", id_col)
