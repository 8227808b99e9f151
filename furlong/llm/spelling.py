"""Operator 12: groups of spelling variants, by Bloom-guided neighbourhoods.

Two words of the vocabulary are near if one code point inserted, deleted or
replaced turns one into the other.  Each word's edits are generated and looked
up in blocked Bloom filters, one for each length of word and each slice of the
vocabulary, which the executors have as broadcasts.  Only edits that a filter
passes are shuffled, to an exact join with the vocabulary, so what a filter lets
through by chance goes there.

Of each pair one side is enough: deletions find the shorter word, replacements
by a greater letter find the greater word.  Hashes of edits follow from the
word's own: with polynomial prefix sums one replaced letter is one
multiplication, so edits become strings only where a filter passes them.

A filter has ``BITS_EACH`` bits a word at every size of the vocabulary.  One
broadcast has at most ``SLICE_WORDS`` words, 32 MB; a larger vocabulary is cut
into slices by hash, and their broadcasts follow one another.  A word has at
most (letters x length) near words, whatever the input, so no key of the join
is hot.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm._shared import lean, small_batches, stored
from furlong.llm._text import mix

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A near word is a word's form if it is so many times as frequent.
FORM_TIMES = 5
BITS_EACH = 16
SLICE_WORDS = 1 << 24
#: A block is four 64-bit words; a key sets two bits of each.
_BLOCK_WORDS = 4
_HELD_WORDS = 200_000
_PIECE = 1 << 20
_PRIME = 0x9E3779B97F4A7C15 | 1
_RUN = re.compile("[a-zÀ-ÿ]+")
Spoiler = Callable[[object, str], str]


def _words(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text, lower-cased in A-Z only, a piece of the text at a time."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + _PIECE)
        while stop < len(text) and (text[stop].isascii() and text[stop].isalpha() or "À" <= text[stop] <= "ÿ"):
            stop += 1
        yield _RUN.findall(text[at:stop].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # bytes know A-Z alone
        at = stop


def _counter(spoiled: Spoiler | None, least: int):
    @lean("spelling")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                own = Counter()
                for part in _words(text.as_py() or ""):
                    own.update(part)
                name = key.as_py() if spoiled else None
                for word, n in own.items():
                    word = spoiled(name, word) if spoiled else word
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= _HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    return count


def misspelt(share: int = 199) -> Spoiler:
    """Takes one letter out of a document's word if ``share`` divides the crc32 of ``<id>:<word>``; a null id is empty there."""

    def spoil(key: object, word: str) -> str:
        h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
        if h % share:
            return word
        k = h % len(word)
        return word[:k] + word[k + 1 :]

    return spoil


def vocabulary(docs: DataFrame, spoiled: Spoiler | None = None, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts with at least so many letters and occurrences.  ``spoiled`` may change a word of a document first."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_counter(spoiled, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each word begins (one more at the end)."""
    words = column.to_pylist()
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _PRIME, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_CODE = mix(np.arange(1, 1 << 16, dtype=np.uint64))


def _code(letters: np.ndarray) -> np.ndarray:
    """What a letter adds to a hash."""
    return _CODE[letters] if not len(letters) or letters.max() < len(_CODE) else mix(letters.astype(np.uint64) + np.uint64(1))


def _sums(letters: np.ndarray) -> np.ndarray:
    """Words of one length (words x letters) to prefix sums of their polynomials (words x letters + 1)."""
    out = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
    np.cumsum(_code(letters) * _powers(letters.shape[1]), axis=1, out=out[:, 1:])
    return out


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and the bits that it sets in the block's words (hashes x words)."""
    h = mix(h)
    block = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    h = mix(h)
    masks = np.empty((len(h), _BLOCK_WORDS), np.uint64)
    for k in range(_BLOCK_WORDS):
        masks[:, k] = (np.uint64(1) << ((h >> np.uint64(12 * k)) & np.uint64(63))) | (np.uint64(1) << ((h >> np.uint64(12 * k + 6)) & np.uint64(63)))
    return block, masks


def _passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash: one block of 32 bytes is read for each."""
    h = mix(h)
    block = ((h >> np.uint64(32)) % np.uint64(len(table))).astype(np.int64)
    first = mix(h)
    ok = np.arange(len(h))
    for k in range(_BLOCK_WORDS):  # most stop at the first word
        g = first[ok]
        mask = (np.uint64(1) << ((g >> np.uint64(12 * k)) & np.uint64(63))) | (np.uint64(1) << ((g >> np.uint64(12 * k + 6)) & np.uint64(63)))
        ok = ok[table[block[ok], k] & mask == mask]
    return ok


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and letters (rows x letters) of the words of each length."""
    codes, first = _letters(column)
    length = np.diff(first)
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        yield rows, codes[first[rows][:, None] + np.arange(n)]


def _of_slice(h: np.ndarray, slices: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(slices)).astype(np.int64)


def _marker(blocks: dict[int, int], here: int, slices: int):
    @lean("spelling")
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block that a task's words set bits of."""
        held = {n: np.zeros((b, _BLOCK_WORDS), np.uint64) for n, b in blocks.items()}
        for batch in batches:
            for _rows, letters in _by_length(batch.column(0)):
                h = _sums(letters)[:, -1]
                h = h[_of_slice(h, slices) == here]
                block, masks = _bits(h, blocks[letters.shape[1]])
                for k in range(_BLOCK_WORDS):
                    np.bitwise_or.at(held[letters.shape[1]][:, k], block, masks[:, k])
        for n, table in held.items():
            used = np.flatnonzero(table.any(1))
            for part in np.array_split(used, len(used) // 100_000 + 1):
                if len(part):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), n), pa.int32()), pa.array(part, pa.int64()), *(pa.array(table[part, k].view(np.int64), pa.int64()) for k in range(_BLOCK_WORDS))], names=["length", "block", *(f"w{k}" for k in range(_BLOCK_WORDS))])

    return mark


def filters(words: DataFrame, sizes: dict[int, int], here: int = 0, slices: int = 1) -> dict[int, np.ndarray]:
    """A blocked Bloom filter for each length of word, of one slice of the vocabulary; ``sizes`` has the words of each length."""
    blocks = {n: max(1, -(-s * BITS_EACH // slices // (64 * _BLOCK_WORDS))) for n, s in sizes.items()}
    names = [f"w{k}" for k in range(_BLOCK_WORDS)]
    marked = words.select("word").mapInArrow(_marker(blocks, here, slices), f"length int, block long, {', '.join(f'{x} long' for x in names)}")
    merged = marked.groupBy("length", "block").agg(*(F.bit_or(x).alias(x) for x in names))
    out = {n: np.zeros((b, _BLOCK_WORDS), np.uint64) for n, b in blocks.items()}
    found = merged.toArrow().to_pandas()  # one slice's blocks
    for n, g in found.groupby("length"):
        out[n][g["block"].to_numpy()] = g[names].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _prober(shared, letters: np.ndarray, here: int, slices: int):
    @lean("spelling")
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = shared.value
        codes = _code(letters)

        def passed(h: np.ndarray, table: np.ndarray) -> np.ndarray:
            at = _passes(table, h)
            return at[_of_slice(h[at], slices) == here] if slices > 1 else at

        for batch in batches:
            words, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            edits: list[str] = []
            source: list[int] = []
            for rows, own in _by_length(batch.column(0)):
                n = own.shape[1]
                total, power = _sums(own), _powers(n)
                for lo in range(0, len(rows), max(1, 200_000 // max(1, len(letters)))):
                    part, sums, ids = own[lo : lo + 200_000 // max(1, len(letters))], total[lo : lo + 200_000 // max(1, len(letters))], rows[lo:]
                    whole = sums[:, -1]
                    for i in range(n):
                        if n - 1 in tables:  # without letter i: what follows moves down by one power
                            shorter = sums[:, i] + (whole - sums[:, i + 1]) * np.uint64(pow(_PRIME, -1, 1 << 64))
                            fresh = np.flatnonzero(part[:, i] != part[:, i - 1]) if i else np.arange(len(part))  # of equal neighbours the first
                            for r in fresh[passed(shorter[fresh], tables[n - 1])].tolist():
                                word = words[ids[r]]
                                edits.append(word[:i] + word[i + 1 :])
                                source.append(ids[r])
                        if n in tables:
                            replaced = whole[:, None] + (codes[None, :] - _code(part[:, i])[:, None]) * power[i]
                            r, c = np.nonzero(letters[None, :] > part[:, i][:, None])
                            at = passed(replaced[r, c], tables[n])
                            for j, x in zip(r[at].tolist(), letters[c[at]].tolist(), strict=True):
                                word = words[ids[j]]
                                edits.append(word[:i] + chr(x) + word[i + 1 :])
                                source.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(edits, pa.string()), pa.array([words[k] for k in source], pa.string()), pa.array([ns[k] for k in source], pa.int64())], names=["edit", "source", "source_n"])

    return probe


def near_words(words: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(word, n, near, near_n): every pair of near words of a vocabulary (word, n), both ways.  ``words`` is read several times: pass a stored table."""
    spark = words.sparkSession
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    letters = sorted(r["x"] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("x")).filter("x != ''").distinct().collect())  # an alphabet
    alphabet = np.array([ord(x) for x in letters], np.uint32)
    slices = max(1, -(-sum(sizes.values()) // slice_words))
    found = None
    for here in range(slices):
        shared = spark.sparkContext.broadcast(filters(words, sizes, here, slices))  # BITS_EACH bits for each of about slice_words words
        hits = words.select("word", "n").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_prober(shared, alphabet, here, slices), "edit string, source string, source_n long")
        exact = hits.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
        found = exact if found is None else found.unionByName(exact)
    pairs = F.array(F.struct(F.col("source").alias("word"), F.col("source_n").alias("n"), F.col("edit").alias("near"), F.col("edit_n").alias("near_n")), F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("source").alias("near"), F.col("source_n").alias("near_n")))
    return found.select(F.inline(pairs))


def spelling_variants(words: DataFrame, times: int = FORM_TIMES, slice_words: int = SLICE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n) of distinct words.

    A word's form is its near word of largest n (of equal ones the first in code-point order) if that is at least ``times`` (2 or more) its own n;
    the root is where the forms lead in the end, the word itself without one.  Words of any length and script; an empty vocabulary gives an empty table.
    """
    words = stored(words.select("word", "n"), "words")
    best = near_words(words, slice_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    is_form = -F.col("best.m") >= times * F.col("n")
    formed = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")), "forms")
    # n grows by `times` with every step, so a chain has at most log(largest n) steps, and each round doubles the steps taken
    links = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    largest = words.agg(F.max("n")).first()[0] or 1
    steps = 1
    while times ** (steps + 1) <= largest:
        far = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        steps *= 2
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
