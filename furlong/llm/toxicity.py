"""Operator 5: toxicity by multiple-instance learning.

A text is a bag of sentences (runs between ``.``, ``!``, ``?`` and line ends).
Each sentence gets p = sigmoid(bias + sum of the weights of its words and their prefixes), and the text
is toxic with probability 1 - prod(1 - p), the noisy-or of its sentences.  Only
texts carry labels; the gradient of their likelihood reaches the sentences
through the noisy-or, so the model also tells which sentences offend.

It is trained on at most ``TRAIN_EACH`` texts of either label, the ones whose
id has the smallest hash, with weights that restore the labels' shares.
Words enter if ``MIN_TEXTS`` training texts have them.  Scoring is one pass over
whole texts, without a shuffle; the model is a bounded table of word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm import _text
from furlong.llm._shared import give_back, lean, small_batches, unused
from furlong.llm._text import mix, pieces

TRAIN_EACH = 2000
MIN_TEXTS = 5
EPOCHS = 150
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD[[33, 46, 63, 10]] = 10  # ends of sentences


@dataclass
class Bags:
    """Words and prefixes of texts by hash, and the sentence of each; sentences by text."""

    words: np.ndarray
    sentence: np.ndarray  # of each word
    text: np.ndarray  # of each sentence
    begin: np.ndarray  # first and last byte of each sentence
    end: np.ndarray


def bags(data: np.ndarray, offsets: np.ndarray) -> Bags:
    n = len(offsets) - 1
    folded = np.full(len(data) + n + 1, 10, np.uint8)
    folded[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _FOLD[data]
    letter = (folded != 32) & (folded != 10)
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    total = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum(_text._BYTE[folded] * _text._power(_text._P, len(folded)), out=total[1:])
    down = _text._power(_text._P_INV, len(folded))
    parts, at = [mix((total[end] - total[begin]) * down[begin])], [begin]
    for k in PREFIXES:  # a prefix is a feature of its own, for inflected and unseen words
        long = begin[end - begin > k]
        parts.append(mix((total[long + k] - total[long]) * down[long] + np.uint64(k)))
        at.append(long)
    words, begin = np.concatenate(parts), np.concatenate(at)
    stops = np.flatnonzero(folded == 10)
    of_stop = np.searchsorted(stops, begin)  # the first stop after the word
    kept, sentence = np.unique(of_stop, return_inverse=True)
    starts = offsets[:-1] + np.arange(n)  # the stop before each text
    text = np.searchsorted(starts, stops[kept] - 1, side="right") - 1
    first = stops[kept - 1] + 1 if len(kept) else kept
    return Bags(words, sentence, text, first - 1 - text, stops[kept] - 1 - text)


@dataclass
class ToxicityModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def sentences(self, b: Bags) -> np.ndarray:
        """The score of each sentence."""
        z = np.full(len(b.text), self.bias)
        if len(self.words) and len(b.words):
            i = np.minimum(np.searchsorted(self.words, b.words), len(self.words) - 1)
            hit = self.words[i] == b.words
            z += np.bincount(b.sentence[hit], self.weights[i[hit]], len(b.text))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def train(texts: list[str], labels: list[int], share: float, epochs: int = EPOCHS) -> ToxicityModel:
    """Adagrad ascent on the weighted likelihood of the labels; ``share`` is the share of label 1 among all labelled texts."""
    model = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -9.0)
    y = np.array(labels, float)
    if not len(y):
        return model
    column, found = pa.array(texts, pa.large_string()), []
    for _lo, _hi, data, offsets in pieces(column):  # in how many texts each word is
        b = bags(data, offsets)
        _, once = np.unique(mix(b.words) + b.text[b.sentence].astype(np.uint64), return_index=True)
        found.append(np.stack(np.unique(b.words[once], return_counts=True)))
    words, inverse = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    seen = np.bincount(inverse, np.concatenate([f[1] for f in found]).astype(float), len(words))
    model.words = words[seen >= MIN_TEXTS]
    model.weights = np.zeros(len(model.words))
    if not len(model.words):
        return model
    word, at, text, sentences = [], [], [], 0
    for lo, _hi, data, offsets in pieces(column):
        b = bags(data, offsets)
        i = np.minimum(np.searchsorted(model.words, b.words), len(model.words) - 1)
        hit = model.words[i] == b.words
        word.append(i[hit].astype(np.int32))
        at.append((b.sentence[hit] + sentences).astype(np.int32))
        text.append(b.text + lo)
        sentences += len(b.text)
    word, at, text = np.concatenate(word), np.concatenate(at), np.concatenate(text)
    ones = max(1.0, y.sum())
    weight = np.where(y == 1, share / ones, (1 - share) / max(1.0, len(y) - ones)) * len(y)
    n, m = len(y), len(text)
    speed, bias_speed = np.full(len(model.words), 1e-8), 1e-8
    model.bias = -5.0
    for _ in range(epochs):
        z = model.bias + np.bincount(at, model.weights[word], m)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        doc = np.clip(noisy_or(p, text, n), 1e-9, 1 - 1e-9)
        slope = np.where(y[text] == 1, p * (1 - doc[text]) / doc[text], -p) * weight[text]
        g = np.bincount(word, slope[at], len(model.words)) - 0.02 * model.weights - 0.02 * np.sign(model.weights)
        speed += g * g
        model.weights += 0.3 * g / np.sqrt(speed)
        g = slope.sum()
        bias_speed += g * g
        model.bias += 0.3 * g / np.sqrt(bias_speed)
    strong = np.abs(model.weights) > 0.05
    model.words, model.weights = model.words[strong], model.weights[strong]
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = TRAIN_EACH) -> ToxicityModel:
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


def _scorer(shared, threshold: float, located: bool):
    @lean("toxicity")
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ToxicityModel = shared.value
        kind = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for lo, hi, data, offsets in pieces(column, 1 << 18):
                b = bags(data, offsets)
                p = model.sentences(b)
                total = noisy_or(p, b.text, hi - lo)
                out = [*[c.slice(lo, hi - lo) for c in batch.columns[:-1]], pa.array(np.clip(total, 0, 1) + 0.0), pa.array((total >= threshold).astype(np.int32))]
                names = [*batch.schema.names[:-1], "score", "predicted"]
                if located:
                    found: list[list[dict]] = [[] for _ in range(hi - lo)]
                    for s in np.flatnonzero(p >= threshold).tolist():
                        t = int(b.text[s])
                        found[t].append({"sentence": data[b.begin[s] : b.end[s]].tobytes().decode("utf-8", "replace").strip(), "score": float(p[s])})
                    out.append(pa.array(found, kind))
                    names.append("offending")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id_col``, score (0 to 1), predicted (1 if score >= threshold), offending (its sentences with such scores, in order).

    A null or wordless text has no sentence and score 0.  Texts of any length are read whole.  A score equal to the threshold
    counts as toxic.  Null or repeated ids are carried along, each row on its own; extra columns are ignored, an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = f"id {kind}, score double, predicted int, offending array<struct<sentence: string, score: double>>"
    return rows.mapInArrow(_scorer(shared, threshold, True), ddl).withColumnRenamed("id", id_col)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, with score and predicted; columns of such names are replaced."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*keep, F.col(text_col).cast("string").alias(unused("__text", docs.columns))).mapInArrow(_scorer(shared, threshold, False), schema)
