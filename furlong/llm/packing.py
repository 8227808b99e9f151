"""Operator 7: best-fit packing by hierarchical residual packing.

A document's ids are those of the tokenizers library for a tokenizer file, then
id 0.  Only documents longer than the capacity are cut, into pieces of the
capacity; the last may be shorter.

The task that tokenizes also packs: in windows of ``WINDOW`` pieces it places
the pieces, largest first, into the bin with the least room that still holds
them, emits the bins that are full but for ``SLACK`` ids, and takes the others
along as items.  Underfull bins then meet as items in fewer and fewer tasks,
``PER_TASK`` of them in each, for more best-fit rounds, until one task holds
them or a round no longer lowers their number.  No round holds more than its
share, and only piece descriptions move, not ids.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm.bpe import byte_alphabet
from furlong.llm._shared import lean, small_batches, stored

CAPACITY = 2048
SLACK = 16
WINDOW = 1 << 15
PER_TASK = 20_000
#: Entries of either dictionary of ids, of chunks of at most ``_KEPT`` characters: some 200 bytes each.
MEMO = 300_000
_KEPT = 256
_CHUNK = re.compile(r"[^ \t-\r]+")
#: Letters of Latin-1 with ASCII punctuation after them: two pieces, the first of which is lower-cased.
_ODD_SPACE = [chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

#: The byte-level alphabet's sign of each byte.
_SHOWN = {b: c for c, b in byte_alphabet().items()}


class _Known(dict):
    """Ids by chunk; what isn't there is encoded and kept."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.piece = tokenizer, tokenizer.model.tokenize
        self.words: dict[str, bytes] = {"": b""}

    def _word(self, piece: str) -> bytes:
        """A piece that the tokenizer neither changes nor splits: its model alone gives the ids."""
        found = self.words.get(piece)
        if found is None:
            if len(self.words) > MEMO:
                self.words.clear()
                self.words[""] = b""
            shown = piece if piece.isascii() else "".join(map(_SHOWN.__getitem__, piece.encode()))
            found = array("I", [t.id for t in self.piece(shown)]).tobytes()
            if len(piece) <= _KEPT:
                self.words[piece] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        m = _PLAIN.fullmatch(chunk)
        if m:
            found = self._word(m[1].lower()) + self._word(m[2])
        else:
            found = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= _KEPT:
            self[chunk] = found
        return found


class ChunkIds:
    """Ids of texts, by encoding the distinct parts of chunks between ASCII white space once.

    For lower-casing byte-level tokenizers that drop white space and keep letters and punctuation apart:
    no piece spans white space and none depends on its neighbours.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [[x["type"] for x in (spec[part] or {}).get(many, [])] for part, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        if steps != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] or spec["pre_tokenizer"]["pretokenizers"][1]["use_regex"]:
            raise ValueError(f"{path}: chunks between white space can't be encoded apart by this tokenizer's parts {steps}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo = _Known(self.tokenizer)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            if len(self.memo) > MEMO:
                self.memo.clear()
            # str.split() knows more white space than the tokenizer drops
            chunks = _CHUNK.findall(t) if any(map(t.__contains__, _ODD_SPACE)) else t.split()
            yield b"".join(map(self.memo.__getitem__, chunks))


_LOADED: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    return _LOADED[path]


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: largest item first, each into the bin with the least room that holds it.

    Bins stand in stacks by room; a bit for every non-empty stack makes the
    search for the least sufficient room one shift.
    """
    bins: list[list[int]] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        above = filled >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            at = stacks[room].pop()
            if not stacks[room]:
                filled ^= 1 << room
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        room -= size
        stacks[room].append(at)
        filled |= 1 << room
    return bins


_ITEM = ["doc_id", "piece", "start", "length", "ids_crc32"]


class _Packer:
    """Items of a task, each a list of pieces; ``pack`` gives the bins and keeps none."""

    def __init__(self):
        self.items: list[tuple[int, list[tuple]]] = []

    def pack(self, slack: int) -> tuple[list[list[tuple]], list[tuple[int, list[tuple]]]]:
        """(nearly full bins, the others with their fill)."""
        done, rest = [], []
        for members in best_fit([n for n, _ in self.items]):
            fill = sum(self.items[i][0] for i in members)
            pieces = [p for i in members for p in self.items[i][1]]
            if fill >= CAPACITY - slack:
                done.append(pieces)
            else:
                rest.append((fill, pieces))
        self.items = []
        return done, rest


def _bins_out(bins: list[list[tuple]], done: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(bins), 2000):
        part = bins[at : at + 2000]
        flat = []
        for b in part:
            offset = 0
            for p in b:
                flat.append((*p[:5], offset))
                offset += p[3]
        ends = np.concatenate(([0], np.cumsum([len(b) for b in part]))).astype(np.int32)
        kind = schema.field("pieces").type.value_type
        columns = zip(*flat, strict=True) if flat else [[]] * len(kind)
        structs = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
        yield pa.RecordBatch.from_arrays([pa.array([done] * len(part)), pa.array([sum(p[3] for p in b) for b in part], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), structs).cast(schema.field("pieces").type)], schema=schema)


def _schema(id_type: T.DataType) -> T.StructType:
    item = T.StructType([T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("offset", T.LongType())])
    return T.StructType([T.StructField("done", T.BooleanType()), T.StructField("fill", T.IntegerType()), T.StructField("pieces", T.ArrayType(item))])


def _cutter(path: str, schema: pa.Schema):
    @lean("packing", _LOADED.clear)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, since = chunk_ids(path), _Packer(), 0
        for batch in batches:
            at, n = 0, batch.num_rows
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy()
            while at < n:
                stop = min(n, at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), 4 << 20))))
                part = batch.slice(at, stop - at)
                at = stop
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += b"\0\0\0\0"
                    for k in range(0, len(ids), 4 * CAPACITY):
                        piece = ids[k : k + 4 * CAPACITY]
                        packer.items.append((len(piece) // 4, [(doc, k // (4 * CAPACITY), k // 4, len(piece) // 4, zlib.crc32(piece))]))
                        since += 1
                if since >= WINDOW:
                    done, packer.items = packer.pack(SLACK)
                    since = 0
                    yield from _bins_out(done, True, schema)
                    if len(packer.items) > WINDOW:  # what no longer merges goes on to the next round
                        yield from _bins_out([p for _, p in packer.items], False, schema)
                        packer.items = []
        done, rest = packer.pack(SLACK)
        yield from _bins_out(done, True, schema)
        yield from _bins_out([p for _, p in rest], False, schema)

    return cut


def _merger(schema: pa.Schema, slack: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer()
        for batch in batches:
            for fill, pieces in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                packer.items.append((fill, [tuple(p[c] for c in _ITEM) for p in pieces]))
            if len(packer.items) >= 4 * PER_TASK:
                done, packer.items = packer.pack(slack)
                yield from _bins_out(done, True, schema)
        done, rest = packer.pack(slack)
        yield from _bins_out(done, True, schema)
        yield from _bins_out([p for _, p in rest], False, schema)

    return merge


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col``, piece (from 0), start (ids of its document before it), length, ids_crc32 (of its
    ids as little-endian unsigned 32-bit integers), sequence_id, offset (its place in the sequence, gapless from 0).

    A null text counts as empty: its one piece is the end id.  Null and
    repeated ids are carried along, each row on its own; extra columns are
    ignored; an empty table gives an empty one.  Ties of size go by input order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = _schema(rows.schema["id"].dataType)
    arrow = to_arrow_schema(kind)
    bins = stored(rows.mapInArrow(_cutter(path, arrow), kind), "bins")
    finished = bins.filter("done")
    left = bins.filter("not done")
    count = left.count()
    while count > 1:
        tasks = -(-count // PER_TASK)
        merged = stored(left.repartition(tasks).mapInArrow(_merger(arrow, SLACK), kind), "bins")
        finished = finished.unionByName(merged.filter("done"))
        left = merged.filter("not done")
        before, count = count, left.count()
        if tasks == 1 or count > 0.9 * before:
            break
    numbered = stored(finished.unionByName(left).withColumn("sequence_id", F.monotonically_increasing_id()), "sequences")
    placed = numbered.select("sequence_id", F.explode("pieces").alias("p"))
    return placed.select(F.col("p.doc_id").alias(id_col), "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")


def packed_ids(docs: DataFrame, pieces: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id and its ids in order, from the pieces that ``pack_documents`` placed.

    Documents are tokenized where they lie and cut as before; a piece is joined by id and number.  Ids must be distinct and not null.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches):
        encode = chunk_ids(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    values = np.frombuffer(ids + b"\0\0\0\0", "<u4").astype(np.int32)
                    out += [(doc, k // CAPACITY, values[k : k + CAPACITY]) for k in range(0, len(values), CAPACITY)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.column(0).type), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], names=["id", "piece", "ids"])

    texts = rows.mapInArrow(cut, f"id {kind}, piece int, ids array<int>").withColumnRenamed("id", id_col)
    joined = pieces.select(id_col, "piece", "sequence_id", "offset").join(texts, [id_col, "piece"])
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
