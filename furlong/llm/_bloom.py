"""Bloom filters of pairs of numbers, built on the executors and sized by the number of pairs.

A filter is at most ``MOST_BITS`` large; beyond the pairs that fit it lets more
through by chance, never fewer.  Whoever uses it joins exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from furlong.llm._shared import lean
from furlong.llm._text import mix

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
BITS_EACH = 16
PROBES = 4
_SLICE_BITS = 1 << 16


def _slots(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Pairs x probes: bit numbers."""
    h = mix(a.astype(np.int64).view(np.uint64) ^ mix(b.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    step = mix(h) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _marker(size: int):
    @lean("bloom")
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The slices that a task's pairs set a bit of."""
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = _slots(batch.column(0).to_numpy(), batch.column(1).to_numpy(), size).ravel()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        slices = bits.reshape(-1, _SLICE_BITS // 8)
        used = np.flatnonzero(slices.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([slices[k].tobytes() for k in used], pa.binary())], names=["slice", "bits"])

    return mark


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(blob.as_buffer(), np.uint8)
            held[k] = held[k] | x if k in held else x.copy()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["slice", "bits"])


def bloom(pairs: DataFrame, n: int) -> np.ndarray:
    """The filter's bytes for a table of ``n`` pairs (two columns of type long, not null)."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * max(1, n) - 1).bit_length()))
    slices = pairs.mapInArrow(_marker(size), "slice int, bits binary").repartition("slice").mapInArrow(_merge, "slice int, bits binary")
    bits = np.zeros(size // 8, np.uint8)
    for row in slices.collect():  # MOST_BITS at most, whatever the input
        bits[row["slice"] * (_SLICE_BITS // 8) : (row["slice"] + 1) * (_SLICE_BITS // 8)] = np.frombuffer(row["bits"], np.uint8)
    return bits


def may_hold(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = _slots(a, b, 8 * len(bits))
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)
