"""Operator 13: document quality by a linear-chain conditional random field over lines.

A text is a chain of its lines that are not blank, each good or bad.  A line's
features are what its bytes look like (how often each pair of kinds of bytes
follows on, shares of letters, capitals, digits and symbols, length of words,
words that repeat the one before, first and last byte, whether the text has the
line again) and the same shares of the lines before and after it; the moves
between good and bad are learned.  Forward-backward gives each line's
probability of being good, and a text's quality is the mean of these, weighted
by the lines' lengths and calibrated on the labels.

Labels belong to whole texts.  Training takes at most ``TRAIN_EACH`` texts of
either label, the ones whose ids have the smallest hashes.  Every line begins
with its text's label; later a line that the chain is sure about takes the
chain's, except that the worst line of a bad text stays bad.

Scoring is one pass over whole texts, without a shuffle, in memory that does not
follow the length of a text but for a few numbers a line; the model is a few
small arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm import _text, langid
from furlong.llm._shared import give_back, lean, small_batches
from furlong.llm._text import mix, pieces

TRAIN_EACH = 1500
EPOCHS = 60
THRESHOLD = 0.3
SURE = 0.95
#: A line of more bytes is read as several lines.
LINE_BYTES = 1 << 15
_SEGMENT = 1 << 18

_KINDS = 12
_KIND = np.full(256, 9, np.uint8)  # other signs
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[32] = _KIND[9] = _KIND[13] = 3
_KIND[[44, 59, 58]] = 4  # , ; :
_KIND[[46, 63]] = 5  # . ?
_KIND[33] = 6  # !
_KIND[124] = 7  # |
_KIND[[39, 45, 40, 41, 34]] = 8  # ' - ( ) "
_KIND[128:192] = 10  # inside of characters
_KIND[192:] = 11
_BUCKETS, _NONE = 16, 16
_FEATURES = ("length", "letters", "capitals", "digits", "signs", "spaces", "word_length", "repeats", "first", "last", "again")


@dataclass
class Lines:
    """The lines of a run of texts."""

    number: np.ndarray  # of the line in its text
    length: np.ndarray
    buckets: np.ndarray  # lines x features
    shape: np.ndarray  # lines x weights given, or lines x pairs of kinds
    first: np.ndarray  # of each text, its first line; one more at the end


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Buckets of a share: none, then steps that are fine near 0 and near 1."""
    x = part / np.maximum(whole, 1)
    return np.where(part == 0, 0, 1 + np.searchsorted([0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8, 0.95, 0.99], x, side="right")).astype(np.int8)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The texts with a newline behind each; first and last byte, text and number of each line, long lines in parts."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, 10, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    stops = np.flatnonzero(out == 10)
    begin = np.concatenate([[0], stops[:-1] + 1])
    last = offsets[1:] + np.arange(n)  # the newline behind each text
    text = np.searchsorted(last, stops)
    number = np.arange(len(stops)) - np.searchsorted(stops, offsets[:-1] + np.arange(n))[text]
    parts = np.maximum(1, -(-(stops - begin) // LINE_BYTES))
    row = np.repeat(np.arange(len(stops)), parts)
    b = begin[row] + (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * LINE_BYTES
    return out, b, np.minimum(b + LINE_BYTES, stops[row]), text[row], number[row]


def lines(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray | None = None) -> Lines:
    """Lines with a letter, digit or sign, and their features; ``weights`` of the pairs of kinds are summed up in place of counting the pairs."""
    n_texts = len(offsets) - 1
    if not n_texts:
        begin = end = text = number = np.zeros(0, np.int64)
    else:
        data, begin, end, text, number = _cuts(data, offsets)
    out: list[tuple] = []
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(end, begin[at] + _SEGMENT, side="right")))
        base = int(begin[at])
        seg = data[base : int(end[stop - 1]) + 1]  # a line's end, too: no segment is empty
        b, e = begin[at:stop] - base, end[at:stop] - base
        kind = _KIND[seg].astype(np.int64)
        total = {}
        for name, of in (("letters", (kind <= 1) | (kind >= 10)), ("capitals", kind == 1), ("digits", kind == 2), ("signs", (kind >= 6) & (kind <= 9)), ("spaces", kind == 3)):
            sums = np.zeros(len(seg) + 1, np.int64)
            np.cumsum(of, out=sums[1:])
            total[name] = sums[e] - sums[b]
        length = e - b
        # words: their hashes, and whether each repeats the one before in its line
        solid = np.zeros(len(seg) + 2, bool)
        solid[1:-1] = (kind != 3) & (seg != 10)
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        wb, we = edge[::2], edge[1::2]
        hashes = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_text._BYTE[seg] * _text._power(_text._P, len(seg)), out=hashes[1:])
        down = _text._power(_text._P_INV, len(seg) + 1)
        words = (hashes[we] - hashes[wb]) * down[wb]
        of_line = np.searchsorted(b, wb, side="right") - 1
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (of_line[1:] == of_line[:-1])
        n_words, repeats = np.bincount(of_line, minlength=len(b)), np.bincount(of_line[same], minlength=len(b))
        whole = mix((hashes[e] - hashes[b]) * down[b])
        full = total["spaces"] < length
        buckets = np.stack([
            np.minimum(np.frexp(np.maximum(length, 1))[1], 15), _share(total["letters"], length), _share(total["capitals"], total["letters"]), _share(total["digits"], length),
            _share(total["signs"], length), _share(total["spaces"], length), np.minimum(2 * length // np.maximum(3 * n_words, 1), 15), _share(repeats, n_words),
            kind[np.minimum(b, len(seg) - 1)], kind[np.maximum(e - 1, 0)],
        ], 1).astype(np.int8)
        pair = np.concatenate([kind[:-1] * _KINDS + kind[1:], [0]])
        pairs = np.maximum(length - 1, 0)
        if weights is None:
            owner = np.repeat(np.arange(len(b)), pairs)
            inside = np.repeat(b, pairs) + np.arange(len(owner)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            shape = np.bincount(owner * _KINDS**2 + pair[inside], minlength=len(b) * _KINDS**2).reshape(len(b), -1).astype(np.float32)
        else:
            sums = np.zeros(len(seg) + 1)
            np.cumsum(weights[pair], out=sums[1:])
            shape = (sums[np.maximum(e - 1, b)] - sums[b])[:, None]
        shape /= np.maximum(pairs, 1)[:, None].astype(shape.dtype)
        out.append(tuple(x[full] for x in (text[at:stop], number[at:stop], length, buckets, shape, whole)))
        at = stop
    if not out:
        return Lines(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(_FEATURES)), np.int8), np.zeros((0, _KINDS**2 if weights is None else 1)), np.zeros(n_texts + 1, np.int64))
    text, number, length, buckets, shape, whole = (np.concatenate(x) for x in zip(*out, strict=True))
    _, inverse, count = np.unique(mix(whole) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
    again = np.minimum(np.frexp(count[inverse])[1] - 1, 15)  # 0: once, 1: two or three times, and so on
    return Lines(number, length, np.column_stack([buckets, again.astype(np.int8)]), shape, np.searchsorted(text, np.arange(n_texts + 1)))


def _beside(x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the lines before and after each, none at a text's ends."""
    edge = np.zeros(len(x.length) + 1, bool)
    edge[x.first] = True
    before, after = np.full_like(x.buckets, _NONE), np.full_like(x.buckets, _NONE)
    inner = np.flatnonzero(~edge[:-1])
    before[inner] = x.buckets[inner - 1]
    after[inner - 1] = x.buckets[inner]
    return before, after


@dataclass
class QualityModel:
    """Weights in favour of good."""

    shape: np.ndarray = field(default_factory=lambda: np.zeros(_KINDS**2))
    own: np.ndarray = field(default_factory=lambda: np.zeros((len(_FEATURES), _BUCKETS + 1)))
    before: np.ndarray = field(default_factory=lambda: np.zeros((len(_FEATURES), _BUCKETS + 1)))
    after: np.ndarray = field(default_factory=lambda: np.zeros((len(_FEATURES), _BUCKETS + 1)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    moves: np.ndarray = field(default_factory=lambda: np.where(np.eye(2, dtype=bool), 0.0, -1.0))
    slope: float = 1.0
    level: float = 0.0
    blank: float = 0.0  # the score of a text without lines

    #: The chain's algebra is that of the language chain; labels are bad and good.
    posteriors = langid.LanguageModel.posteriors

    def emissions(self, x: Lines, shape: np.ndarray) -> np.ndarray:
        z = shape.astype(float)
        before, after = _beside(x)
        for k in range(len(_FEATURES)):
            z += self.own[k][x.buckets[:, k]] + self.before[k][before[:, k]] + self.after[k][after[:, k]]
        return np.stack([np.zeros(len(z)), np.clip(z, -30, 30)], 1)

    def good(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Lines, np.ndarray]:
        """Lines and the probability that each is good."""
        x = lines(data, offsets, self.shape)
        return x, self.posteriors(self.emissions(x, x.shape[:, 0]), x.first)[:, 1]

    def quality(self, x: Lines, good: np.ndarray) -> np.ndarray:
        """The score of each text."""
        n = len(x.first) - 1
        text = np.repeat(np.arange(n), np.diff(x.first))
        weight = np.bincount(text, x.length, n)
        z = self.slope * _logit(np.bincount(text, x.length * good, n) / np.maximum(weight, 1)) + self.level
        return np.where(weight > 0, 1 / (1 + np.exp(-z)), self.blank)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(texts: list[str], labels: list[int], share: float, epochs: int = EPOCHS) -> QualityModel:
    """Adagrad ascent on the chains' conditional likelihood; ``share`` is the share of label 1 among all labelled texts."""
    model = QualityModel()
    y = np.array(labels, int)
    model.level = float(_logit(np.array(share)))
    if not len(y):
        return model
    parts = [lines(data, offsets) for _lo, _hi, data, offsets in pieces(pa.array(texts, pa.large_string()))]
    shift = np.cumsum([0, *(len(p.length) for p in parts)])
    x = Lines(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("number", "length", "buckets", "shape")), np.concatenate([*(p.first[:-1] + s for p, s in zip(parts, shift, strict=False)), shift[-1:]]))
    del parts
    lined = np.diff(x.first) > 0
    model.blank = float((y[~lined] == 1).sum() / (len(y[~lined]) + 1))
    if len(set(y[lined].tolist())) < 2:
        model.slope = 0.0
        return model
    n, text = len(x.length), np.repeat(np.arange(len(y)), np.diff(x.first))
    ones = max(1, int((y == 1).sum()))
    weight = np.where(y == 1, share / ones, (1 - share) / max(1, len(y) - ones)) * len(y)
    even = (np.where(y == 1, 0.5 / ones, 0.5 / max(1, len(y) - ones)) * len(y))[text] / np.maximum(np.diff(x.first), 1)[text]  # each text and either label counts alike
    before, after = _beside(x)
    tables = [(model.own, x.buckets), (model.before, before), (model.after, after)]
    speeds = [np.full(t.shape, 1e-6) for t, _ in tables]
    shape_speed, move_speed = np.full(len(model.shape), 1e-6), np.full((2, 2), 1e-6)
    first = np.zeros(n, bool)
    first[x.first[:-1][lined]] = True
    inner = np.flatnonzero(~first)
    for epoch in range(epochs):
        post, moved = model.posteriors(model.emissions(x, x.shape @ model.shape), x.first, pairs=True)
        good = post[:, 1]
        target = y[text].copy()
        if epoch >= epochs // 3:
            worst = np.full(len(y), 2.0)
            np.minimum.at(worst, text, good)
            target[(good > SURE) & (good > worst[text])] = 1
            target[good < 1 - SURE] = 0
        slope = (target - good) * even
        g = x.shape.T @ slope - 1e-3 * model.shape
        shape_speed += g * g
        model.shape += 0.3 * g / np.sqrt(shape_speed)
        for (table, at), speed in zip(tables, speeds, strict=True):
            g = np.stack([np.bincount(at[:, k], slope, _BUCKETS + 1) for k in range(len(_FEATURES))]) - 1e-3 * table
            speed += g * g
            table += 0.1 * g / np.sqrt(speed)
        seen = np.bincount(2 * target[inner - 1] + target[inner], minlength=4).reshape(2, 2)
        g = seen - moved - 1e-1 * model.moves
        move_speed += g * g
        model.moves = np.clip(model.moves + 0.1 * g / np.sqrt(move_speed), -9, 9)
    good = model.posteriors(model.emissions(x, x.shape @ model.shape), x.first)[:, 1]
    length = np.bincount(text, x.length, len(y))
    z = _logit(np.bincount(text, x.length * good, len(y)) / np.maximum(length, 1))[lined]
    w, t = weight[lined], (y[lined] * 1.0)
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps for slope and level, held back by a weak prior
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([np.sum(w * (t - p) * z) - 0.1 * (a - 1), np.sum(w * (t - p)) - 0.1 * b])
        v = w * p * (1 - p)
        h = np.array([[np.sum(v * z * z) + 0.1, np.sum(v * z)], [np.sum(v * z), np.sum(v) + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.05, a + step[0]), b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.level = float(a), float(b)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", each: int = TRAIN_EACH) -> QualityModel:
    """A model of at most ``each`` documents of either label, those whose ids have the smallest hashes.

    Labels other than 0 and 1, null ids and documents without text are left out; an id with both labels counts as 1, one of several texts has the first.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(each) for y in (0, 1)]
    # the picked ids are a bounded table
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").join(F.broadcast(picked[0].unionByName(picked[1])), "id")
    sample = sorted(texts.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect())
    model = train([r["text"] for r in sample], [r["y"] for r in sample], ones / max(1, n))
    give_back()
    return model


def _scorer(shared, threshold: float):
    kind = pa.list_(pa.struct([("line", pa.int64()), ("good", pa.float64())]))

    @lean("quality")
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: QualityModel = shared.value
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1), _SEGMENT):
                x, good = model.good(data, offsets)
                total = np.clip(model.quality(x, good), 0, 1)
                bad = np.flatnonzero(good < 0.5)
                ends = np.searchsorted(bad, x.first)
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x.number[bad], pa.int64()), pa.array(good[bad], pa.float64())], names=["line", "good"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(total + 0.0), pa.array((total >= threshold).astype(np.int32)), found.cast(kind)], names=["id", "score", "predicted", "bad_lines"])

    return score


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id_col``, score (0 to 1), predicted (1 if score >= threshold), bad_lines (number from 0, probability of being good).

    A null text or one of blank lines has no chain and the score that such texts have by their labels, 0 if none is labelled.  A line of more than
    ``LINE_BYTES`` is read as several of one number.  Null or repeated ids are carried along, each row on its own; extra columns are ignored,
    an empty table gives an empty one, a model of one label gives its share to all.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = f"id {kind}, score double, predicted int, bad_lines array<struct<line: long, good: double>>"
    return rows.mapInArrow(_scorer(shared, threshold), ddl).withColumnRenamed("id", id_col)
