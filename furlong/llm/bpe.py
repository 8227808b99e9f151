"""Operator 10: byte-level BPE encoding and decoding by prefix-sharing trie traversal.

A task splits its texts into chunks (an optional blank and a run without white
space, or white space), inserts the distinct pieces of chunks it hasn't met into a
trie, and walks the trie depth-first.  The trie is path-compressed: words stand in byte order,
each with the length of the prefix that it shares with the word before it, which is
the depth at which it branches off.  At each node stands the last token of
the encoding of the prefix that the node spells: the longest vocabulary token
``t`` that ends there such that (last token of the rest, ``t``) is an adjacent pair that
merging leaves alone.  The encoding of a shared prefix is thus worked out once;
a word's ids come from walking the last tokens back.  Which tokens end at a node is known
from an automaton over the vocabulary, whose moves are worked out when first made.

Whether merging leaves a pair alone is worked out once for each pair.  Chunks' ids are kept in a dictionary of at
most ``MEMO_BYTES`` bytes, which is emptied when full.  Texts are taken in segments of
about ``SEGMENT`` characters, cut at blanks; a run without white space costs about forty
bytes of memory for each of its bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm._shared import lean, small_batches

MEMO_BYTES = 96 << 20
_ENTRY = 160  # bytes of an entry's objects, besides its text and ids
_PAIRS = 400_000
SEGMENT = 1 << 19
LONG = 1 << 14
#: White_Space of Unicode, as the tokenizer's pattern has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
_CUT = re.compile(rf"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The byte-level pre-tokenizer's pattern (a fixed value).
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the byte-level alphabet, each with its byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE tokenizer read from a tokenizer file.

    ``encode`` gives the ids that the tokenizers library gives without adding special
    tokens; strings of the file's special tokens in a text become their ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        model = spec["model"]
        self.vocab = {to_bytes(t): i for t, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = dict.fromkeys(self.vocab.values(), -1)  # the rank of a token's merge
        self.halves: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            a, b = to_bytes(a), to_bytes(b)
            both, half = self.vocab[a + b], (self.vocab[a], self.vocab[b])
            self.ranks[half] = r
            if self.made[both] < 0:
                self.made[both], self.halves[both] = r, half
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in self.vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.four = {i: i.to_bytes(4, "little") for i in self.vocab.values()}
        self._automaton()
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._apart: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self._held = 0

    def _automaton(self) -> None:
        """States are the prefixes of tokens; a state's ends are the tokens that are its suffixes, longest first, with their lengths."""
        depth, parent_of, byte_of, root_child = [0], [0], [0], {}
        self.goto: dict[int, int] = root_child  # state << 8 | byte -> state
        own: list[int] = [-1]
        for word, token in self.vocab.items():
            at = 0
            for c in word:
                k = at << 8 | c
                to = self.goto.get(k)
                if to is None:
                    to = self.goto[k] = len(depth)
                    depth.append(depth[at] + 1)
                    parent_of.append(at)
                    byte_of.append(c)
                    own.append(-1)
                at = to
            own[at] = token
        self.fail = [0] * len(depth)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(depth)
        self.tree = dict(self.goto)
        for state in sorted(range(1, len(depth)), key=depth.__getitem__):
            if depth[state] > 1:
                back = self.fail[parent_of[state]]
                while (to := self.tree.get(back << 8 | byte_of[state])) is None and back:
                    back = self.fail[back]
                self.fail[state] = to or 0
            rest = self.ends[self.fail[state]]
            self.ends[state] = ((own[state], depth[state]), *rest) if own[state] >= 0 else rest

    def _move(self, state: int, c: int) -> int:
        """The state after a byte; the move is kept."""
        back = state
        while (to := self.tree.get(back << 8 | c)) is None and back:
            back = self.fail[back]
        if len(self.goto) > len(self.tree) + _PAIRS:
            self.goto = dict(self.tree)
        self.goto[state << 8 | c] = to or 0
        return to or 0

    # -- encoding

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b ends in just these two.

        Goes back in time from the end: x is what touches the boundary from the left and y from
        the right, until when each lasts is known, and whichever was made later comes apart.
        A merge of x and y would have come first if its rank is below that which ends x
        (at equal rank the left one is first) and not above that which ends y.
        """
        x, y, x_ends, y_ends = a, b, 1 << 60, 1 << 60
        while True:
            rank = self.ranks.get((x, y))
            if rank is not None and rank < x_ends and rank <= y_ends:
                found = False
                break
            x_made, y_made = self.made[x], self.made[y]
            if x_made < 0 and y_made < 0:
                found = True
                break
            if x_made > y_made:
                x, x_ends = self.halves[x][1], x_made
            else:
                y, y_ends = self.halves[y][0], y_made
        if len(self._apart) > _PAIRS:
            self._apart.clear()
        self._apart[a << 32 | b] = found
        return found

    def encode_words(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct words as little-endian 32-bit bytes, by one depth-first walk of their trie."""
        out: dict[bytes, bytes] = {}
        ends, stay, four = self.ends, self._stay_apart, self.four
        # by depth, one more than it: the automaton's state, the last token of that prefix and its length
        states, last, size = [0], [-1], [0]
        before = b""
        for word in sorted(words):
            n = len(word)
            if n > LONG and isinstance(last, list):
                states, last, size = array("i", states), array("i", last), array("i", size)
            elif n <= LONG and not isinstance(last, list):
                states, last, size, before = [0], [-1], [0], b""
            shared = 0
            if before:
                most = min(n, len(before))
                if word[:most] == before[:most]:
                    shared = most
                else:  # the branching depth, by halves
                    low, high = 0, most
                    while high - low > 1:
                        middle = (low + high) // 2
                        if word[low:middle] == before[low:middle]:
                            low = middle
                        else:
                            high = middle
                    shared = low
            del states[shared + 1 :], last[shared + 1 :], size[shared + 1 :]
            before, state = word, states[shared]
            goto, apart = self.goto, self._apart
            for depth in range(shared, n):
                c = word[depth]
                to = goto.get(state << 8 | c)
                if to is None:
                    to = self._move(state, c)
                    goto = self.goto
                state = to
                for token, length in ends[state]:
                    at = last[depth + 1 - length]
                    if at < 0:
                        break
                    ok = apart.get(at << 32 | token)
                    if stay(at, token) if ok is None else ok:
                        break
                states.append(state)
                last.append(token)
                size.append(length)
            ids, at = [], n
            while at:
                ids.append(four[last[at]])
                at -= size[at]
            ids.reverse()
            out[word] = b"".join(ids)
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Adds the ids of chunks to the memo, as little-endian 32-bit bytes."""
        plain = {c: c.encode() for c in chunks if c.isalpha() or c[:1] == " " and c[1:].isalpha()}
        others = {c: [p.encode() for p in _PIECE.findall(c)] for c in chunks if c not in plain}
        words = set(plain.values())
        for many in others.values():
            words.update(many)
        ids = self.encode_words(words)
        memo = self.memo
        for c, w in plain.items():
            memo[c] = ids[w]
        for c, many in others.items():
            memo[c] = b"".join([ids[w] for w in many])
        self._held += sum(map(len, ids.values())) + sum(map(len, chunks)) + _ENTRY * len(chunks)

    def _segments(self, text: str) -> Iterator[str | bytes]:
        """Stretches of text that end where a chunk does, and special tokens as their ids."""
        run = self._special.split(text) if self._special and any(s in text for s in self.special) else [text]
        for k, part in enumerate(run):
            if k % 2:
                yield self.special[part].to_bytes(4, "little")
                continue
            at = 0
            while len(part) - at > SEGMENT:
                cut = _CUT.search(part, at + SEGMENT)
                if cut is None:
                    break
                yield part[at : cut.start()]
                at = cut.start()
            yield part[at:] if at else part

    def _settle(self, parts: list[tuple[int, str | bytes]], done: list[list[bytes]]) -> None:
        """Adds the ids of (row, stretch) to the rows of ``done``."""
        cut = [(row, x if isinstance(x, bytes) else _CHUNK.findall(x)) for row, x in parts]
        every: set[str] = set()
        for _, x in cut:
            if not isinstance(x, bytes):
                every.update(x)
        if self._held > MEMO_BYTES:
            self.memo.clear()
            self._held = 0
        memo = self.memo
        self._learn({c for c in every if c not in memo})
        get = memo.__getitem__
        for row, x in cut:
            done[row].append(x if isinstance(x, bytes) else b"".join(map(get, x)))

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text, its ids as little-endian 32-bit bytes."""
        done: list[list[bytes]] = [[] for _ in texts]
        parts: list[tuple[int, str | bytes]] = []
        held = 0
        for row, text in enumerate(texts):
            for part in self._segments(text):
                parts.append((row, part))
                held += len(part)
                if held > 4 * SEGMENT:
                    self._settle(parts, done)
                    parts, held = [], 0
        self._settle(parts, done)
        for row in done:
            yield b"".join(row)

    # -- decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """One tokenizer for a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _coder(path: str, view: Callable[[ByteBpe, bytes], dict], fields: list[pa.Field]):
    @lean("bpe", _LOADED.clear)
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            at, n = 0, batch.num_rows
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy()
            while at < n:  # a few megabytes of text at a time
                stop = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), 4 << 20)))
                stop = min(stop, n)
                part = batch.slice(at, stop - at)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [view(bpe, ids) for ids in bpe.encode_texts(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[f.name] for r in rows], f.type) for f in fields]], names=["id", *[f.name for f in fields]])
                at = stop

    return code


def _whole(bpe: ByteBpe, ids: bytes) -> dict:
    values = np.frombuffer(ids, "<u4")
    return {"ids": values.astype(np.int32), "decoded": bpe.decode(values)}


def _digests(bpe: ByteBpe, ids: bytes) -> dict:
    values = np.frombuffer(ids, "<u4")
    return {"n_tokens": len(values), "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(bpe.decode(values).encode()).hexdigest()}


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, ids (array of int) and decoded (the text those ids decode to).

    With ``digests`` the row holds n_tokens, ids_sha256 and decoded_sha256 of the same values instead, so that long rows needn't leave the task.
    A null text counts as empty and has no ids.  Null or repeated ids are
    carried along; extra columns are ignored; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    if digests:
        fields, ddl, view = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())], "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests
    else:
        fields, ddl, view = [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())], "ids array<int>, decoded string", _whole
    return rows.mapInArrow(_coder(path, view, fields), f"id {kind}, {ddl}").withColumnRenamed("id", id_col)
