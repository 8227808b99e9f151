"""Operator 9: language identification by a linear-chain conditional random field over words.

A text is read as its runs of letters, each a position of a chain whose labels
are the languages.  A position's features are the byte n-grams of the word
(two to four bytes), those with the word's edges (its affixes), and membership
in a lexicon of frequent words; label transitions are learned.  Forward-backward
gives each word's posterior, so a code-switched text gets the languages of its
parts, and the text's language is the one with the most expected words.

Training takes at most ``TRAIN_ROWS`` labelled rows, the ones with the smallest
hash of their id, so it is bounded and repeatable.  Rows carry one language
for all their words, therefore training first takes it for every word, then
relabels passages that the chain gives to another language and learns again:
from there come the switches in the transitions.  The model is a few arrays of
fixed size for each language; prediction is one pass over the texts, without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm._shared import give_back, lean, small_batches, unused
from furlong.llm._text import mix, pieces

TRAIN_ROWS = 1000
EPOCHS = 12
LEXICON = 4096
_BITS = 18
_CHAIN = 128
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)  # anything but letters counts as a space
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with a space before every text and one at the end, and the places of those spaces."""
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _FOLD[data]
    after = out[1:]
    upper = (out[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)  # letters of Latin-1 with accents
    after[upper] += 32
    return out, offsets + np.arange(n + 1)


def _grams(text: np.ndarray) -> list[np.ndarray]:
    """For each order, the feature number of the n-gram that begins at each byte, -1 where a space is inside it."""
    wide = np.concatenate([text, np.full(3, 32, np.uint8)]).astype(np.int64)
    n = len(text)
    a, b, c, d = (wide[k : n + k] for k in range(4))
    space = wide == 32
    sb, sc = space[1 : n + 1], space[2 : n + 2]
    two = (a << 8) | b
    three = (two << 8) | c
    four = (three << 8) | d
    prime = np.int64(0x9E3779B1)
    size = 1 << _BITS
    first, second = 1 << 16, (1 << 16) + size
    return [np.where(space[:n] & sb, -1, two), np.where(sb, -1, first + ((three * prime) >> 11) % size), np.where(sb | sc, -1, second + ((four * prime) >> 13) % size)]


@dataclass
class Chain:
    """Words of a batch of texts."""

    begin: np.ndarray  # of each word, in the canonical text
    end: np.ndarray
    first: np.ndarray  # of each text, its first word; one more at the end


def _words(text: np.ndarray, starts: np.ndarray) -> Chain:
    letter = text != 32
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    return Chain(begin, end, np.searchsorted(begin, starts))


def _hashes(text: np.ndarray, chain: Chain) -> np.ndarray:
    from furlong.llm import _text as t

    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(t._BYTE[text] * t._power(t._P, len(text)), out=total[1:])
    return mix((total[chain.end] - total[chain.begin]) * t._power(t._P_INV, len(text))[chain.begin])


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # features x labels
    lexicon: np.ndarray  # sorted word hashes
    lexicon_weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray  # label x label, log

    def emissions(self, text: np.ndarray, chain: Chain) -> np.ndarray:
        """Log potentials, words x labels."""
        total = np.zeros((len(text) + 1, len(self.labels)))
        score = np.zeros((len(text), len(self.labels)), np.float32)
        for index in _grams(text):
            score += self.weights[index]  # the last row is zero, for -1
        np.cumsum(score, axis=0, dtype=np.float64, out=total[1:])
        out = total[chain.end] - total[chain.begin - 1]  # with the n-grams that begin at the blank before
        if len(self.lexicon):
            h = _hashes(text, chain)
            i = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
            out += np.where((self.lexicon[i] == h)[:, None], self.lexicon_weights[i], 0)
        return out

    def posteriors(self, emissions: np.ndarray, first: np.ndarray, pairs: bool = False):
        """Forward-backward of all chains side by side: words x labels; with pairs also the expected moves, labels x labels.

        Chains stand longest first, so that step t works on a prefix of them.
        """
        n, k = emissions.shape
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        base, sizes = first[:-1][order], length[order]
        e = np.exp(emissions - emissions.max(1, keepdims=True)) if n else emissions
        move, start = np.exp(self.moves), np.exp(self.start)
        forward, backward = np.empty((n, k)), np.empty((n, k))
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        before = None
        for t, m in enumerate(active.tolist()):
            at = base[:m] + t
            now = (start if before is None else before[:m] @ move) * e[at]
            now /= now.sum(1, keepdims=True)
            forward[at] = before = now
        after = np.ones((0, k))
        for t in range(len(active) - 1, -1, -1):
            m = int(active[t])
            at = base[:m] + t
            now = np.ones((m, k))
            now[: len(after)] = (after * e[at[: len(after)] + 1]) @ move.T
            now /= now.sum(1, keepdims=True)
            backward[at] = after = now
        post = forward * backward
        post /= post.sum(1, keepdims=True)
        if not pairs:
            return post
        inner = np.ones(n, bool)
        inner[first[:-1][length > 0]] = False
        at = np.flatnonzero(inner)
        come, go = forward[at - 1], e[at] * backward[at]
        go /= np.einsum("tj,tj->t", come @ move, go)[:, None]
        return post, move * (come.T @ go)


def train(texts: list[str], langs: list[str], labels: list[str], epochs: int = EPOCHS) -> LanguageModel:
    """Gradient ascent on the conditional likelihood, over whole texts cut into chains of ``_CHAIN`` words."""
    k = len(labels)
    number = {x: i for i, x in enumerate(labels)}
    n_features = (1 << 16) + 2 * (1 << _BITS) + 1
    model = LanguageModel(labels, np.zeros((n_features, k), np.float32), np.zeros(0, np.uint64), np.zeros((0, k)), np.zeros(k), np.where(np.eye(k, dtype=bool), 0.0, -4.0))
    if not texts or k < 2:
        return model
    ids, gold, cut, grams, spans, base = [], [], [0], [], {}, 0
    vocabulary: dict[int, int] = {}
    at = 0
    column = pa.array(texts, pa.large_string())
    for lo, _hi, data, offsets in pieces(column):
        text, starts = _canonical(data, offsets)
        chain = _words(text, starts)
        h = _hashes(text, chain)
        known = _grams(text)
        for j, x in enumerate(h.tolist()):
            w = vocabulary.get(x)
            if w is None:
                w = vocabulary[x] = len(vocabulary)
                b, e = int(chain.begin[j]), int(chain.end[j])
                g = np.concatenate([g[b - 1 : e] for g in known])
                grams.append(g[g >= 0])
            ids.append(w)
        for r, (a, b) in enumerate(zip(chain.first[:-1].tolist(), chain.first[1:].tolist(), strict=True)):
            gold += [number[langs[lo + r]]] * (b - a)
            cut += [at + s for s in range(min(_CHAIN, b - a), b - a, _CHAIN)] + ([at + b - a] if b > a else [])
            at += b - a
    word, y, first = np.array(ids), np.array(gold), np.array(cut)
    if not len(word):
        return model
    v = len(vocabulary)
    hashes = np.fromiter(vocabulary, np.uint64, v)
    owner = np.repeat(np.arange(v), [len(g) for g in grams])
    used, feature = np.unique(np.concatenate(grams), return_inverse=True)
    del grams
    weights = np.zeros((len(used), k))
    count = np.bincount(word, minlength=v)
    frequent = np.argsort(-count, kind="stable")[:LEXICON]
    frequent = frequent[np.argsort(hashes[frequent])]
    model.lexicon, model.lexicon_weights = hashes[frequent], np.zeros((len(frequent), k))
    weight_speed, lexicon_speed, move_speed = np.full(weights.shape, 1e-6), np.full(model.lexicon_weights.shape, 1e-6), np.full((k, k), 1e-6)
    n = len(word)

    def emit() -> np.ndarray:
        out = np.stack([np.bincount(owner, weights[feature, j], v) for j in range(k)], 1)
        out[frequent] += model.lexicon_weights
        return out[word]

    def learn(target: np.ndarray) -> None:
        post, moved = model.posteriors(emit(), first, pairs=True)
        onehot = np.zeros((n, k))
        onehot[np.arange(n), target] = 1
        slope = onehot - post
        by_word = np.stack([np.bincount(word, slope[:, j], v) for j in range(k)], 1)
        gradient = np.stack([np.bincount(feature, by_word[owner, j], len(used)) for j in range(k)], 1) - 1e-2 * weights
        np.add(weight_speed, gradient**2, out=weight_speed)
        weights[:] += 0.3 * gradient / np.sqrt(weight_speed)
        gradient = by_word[frequent] - 1e-2 * model.lexicon_weights
        np.add(lexicon_speed, gradient**2, out=lexicon_speed)
        model.lexicon_weights += 0.3 * gradient / np.sqrt(lexicon_speed)
        inner = np.ones(n, bool)
        inner[first[:-1]] = False
        here = np.flatnonzero(inner)
        seen = np.zeros((k, k))
        np.add.at(seen, (target[here - 1], target[here]), 1)
        gradient = seen - moved - 1e-1 * model.moves
        np.add(move_speed, gradient**2, out=move_speed)
        model.moves += np.clip(0.2 * gradient / np.sqrt(move_speed), -0.5, 0.5)
        model.moves = np.maximum(model.moves, -9.0)

    for epoch in range(epochs):
        target = y
        if epoch >= epochs // 2:  # passages that the chain is sure about get its language
            post = model.posteriors(emit(), first)
            sure = post.argmax(1)
            target = np.where(post[np.arange(n), sure] > 0.95, sure, y)
        learn(target)
    model.weights[used] = weights
    return model


_SPANS = pa.struct([("lang", pa.string()), ("words", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])


def _predictor(shared, spans: bool):
    @lean("langid")
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            lang, score, parts = [], [], []
            if not model.labels:
                lang, score, parts = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows, [pa.array([[]] * batch.num_rows, pa.list_(_SPANS))]
            for lo, hi, emissions, first, places in _emitted(model, column, spans) if model.labels else ():
                post = model.posteriors(emissions, first)
                total = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, 0)])
                share = total[first[1:]] - total[first[:-1]]
                words = np.diff(first)
                best = share.argmax(1)
                for r in range(hi - lo):
                    if words[r] == 0 or not _has_letter(column[lo + r].as_py()):
                        lang.append(UNKNOWN)
                        score.append(0.0)
                    else:
                        lang.append(model.labels[best[r]])
                        score.append(min(1.0, float(share[r, best[r]] / words[r])))
                if spans:
                    parts.append(_runs(model.labels, post.argmax(1), first, places))
            out = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            more = [pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_SPANS))] if spans else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out, *more], names=[*batch.schema.names[:-1], "lang_pred", "score", *(["spans"] if spans else [])])

    return predict


def _runs(labels: list[str], label: np.ndarray, first: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> pa.ListArray:
    """For each text, its runs of words of one language: the language, the number of words, and the bytes from the first word's begin to the last one's end."""
    begin, end = places
    new = np.ones(len(label), bool)
    new[1:] = label[1:] != label[:-1]
    new[first[:-1][first[:-1] < len(label)]] = True
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(label))
    names = pa.array(labels, pa.string()).take(pa.array(label[starts], pa.int32()))
    runs = pa.StructArray.from_arrays([names, pa.array(stops - starts, pa.int32()), pa.array(begin[starts], pa.int64()), pa.array(end[stops - 1] if len(starts) else end[:0], pa.int64())], fields=list(_SPANS))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, first), pa.int32()), runs)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _emitted(model: LanguageModel, column: pa.Array, spans: bool, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple]]:
    """Emissions of runs of whole texts, taken a piece at a time and handed on about a megabyte at a time; with spans, each word's first and last byte in its text."""
    lo, held, parts, firsts, places, rows, words = 0, 0, [], [np.zeros(1, np.int64)], [], 0, 0
    for _a, b, data, offsets in pieces(column, 1 << 17):
        text, starts = _canonical(data, offsets)
        chain = _words(text, starts)
        parts.append(model.emissions(text, chain))
        firsts.append(chain.first[1:] + words)
        if spans:  # a blank stands before every text
            own = np.repeat(starts[:-1] + 1, np.diff(chain.first))
            places.append((chain.begin - own, chain.end - own))
        words += len(chain.begin)
        held += len(data)
        rows = b
        if held >= most:
            yield lo, rows, np.concatenate(parts), np.concatenate(firsts), _joined(places)
            lo, held, parts, firsts, places, words = rows, 0, [], [np.zeros(1, np.int64)], [], 0
    if parts:
        yield lo, rows, np.concatenate(parts), np.concatenate(firsts), _joined(places)


def _joined(places: list[tuple[np.ndarray, np.ndarray]]) -> tuple:
    return tuple(map(np.concatenate, zip(*places, strict=True))) if places else ()


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model of at most ``rows`` documents, as many of each language, the ones whose ids have the smallest hashes; the languages are all that ``labelled`` has.

    Rows without id, text or language are left out; an id of several texts or languages has the first in order.
    """
    known = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("id is not null and text is not null and lang is not null")
    labels = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not labels:
        return train([], [], labels)
    each = max(1, rows // len(labels))
    first = [known.filter(F.col("lang") == x).select("id").orderBy(F.xxhash64("id"), "id").limit(each) for x in labels]
    picked = reduce(DataFrame.unionByName, first).distinct()
    # the picked ids are a bounded table
    sample = known.join(F.broadcast(picked), "id").groupBy("id").agg(F.min(F.struct("text", "lang")).alias("r")).select("id", "r.text", "r.lang")
    found = sorted(sample.collect())
    model = train([r["text"] for r in found], [r["lang"] for r in found], labels)
    give_back()
    return model


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """One row per input row: ``id_col``, lang_pred, score (the share of expected words that are of that language, 0 to 1) and spans (runs
    of words of one language in order: lang, words, and where the run begins and ends in the text's UTF-8 bytes; left out unless ``spans``).

    ``und`` with score 0 stands for a null text, one without letters, and a model
    without languages.  Ties go to the language first in order.  Texts of any length are read whole.  Null or
    repeated ids are carried along, each row on its own; extra columns are ignored; an empty table
    gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = ", spans array<struct<lang: string, words: int, begin: long, end: long>>" if spans else ""
    return rows.mapInArrow(_predictor(shared, spans), f"id {kind}, lang_pred string, score double{more}").withColumnRenamed("id", id_col)


def with_span_texts(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``found`` (of ``identify_languages``) with the text of each span; ids must be unique."""
    texts = docs.select(F.col(id_col), F.encode(F.col(text_col), "utf-8").alias("__bytes"))
    cut = lambda s: F.decode(F.substring(F.col("__bytes"), s["begin"] + 1, s["end"] - s["begin"]), "utf-8")
    return found.join(texts, id_col).withColumn("spans", F.transform("spans", lambda s: s.withField("text", cut(s)))).drop("__bytes")


def with_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with lang_pred and score added; a column of such a name is replaced."""
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(unused("__text", docs.columns)))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predictor(shared, False), schema)
