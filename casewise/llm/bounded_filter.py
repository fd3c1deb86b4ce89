"""Bitmaps of fixed size over hashed keys, folded from a distributed table without collecting the keys.

``key_filter(table, column, least)`` gives the cells that at least ``least`` (1 or 2) rows touch. ``column`` holds 64-bit numbers packed
into binary, any number a row. A bitmap has ``bits`` cells whatever the input; one too small for its input only lets more keys pass.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS, SLICES, FLUSH = 1 << 27, 64, 1 << 20


def cells_of(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (keys >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


LISTS = "slice int, cells binary, again binary"


STRIDE = (1 << 16) - 1


def pack_gaps(cells: np.ndarray) -> bytes:
    """Ascending cells as the steps between them, 16 bits each; a longer step is told by full strides before it."""
    step = np.diff(cells, prepend=0)
    strides = step // STRIDE
    out = np.full(len(cells) + int(strides.sum()), STRIDE, "<u2")
    out[np.cumsum(strides + 1) - 1] = step % STRIDE
    return out.tobytes()


def unpack_gaps(packed: bytes) -> np.ndarray:
    step = np.frombuffer(packed, "<u2")
    return np.cumsum(step, dtype=np.int64)[step != STRIDE]


def pack_cells(keys: list[np.ndarray], bits: int = BITS) -> pa.RecordBatch:
    """Touched cells, slice by slice, and which of them were touched again."""
    width = bits // SLICES
    cells, counts = np.unique(np.concatenate([cells_of(k, bits) for k in keys]), return_counts=True)
    cuts = np.searchsorted(cells, np.arange(SLICES + 1) * width)
    rows = [(s, pack_gaps(cells[a:b] - s * width), np.packbits(counts[a:b] > 1).tobytes())
            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["slice", "cells", "again"])


def pack_all(parts, bits: int = BITS):
    """``pack_cells`` over a stream of key arrays, about ``FLUSH`` keys at a time."""
    held, size = [], 0
    for keys in parts:
        if len(keys):
            held.append(keys)
            size += len(keys)
        if size >= FLUSH:
            yield pack_cells(held, bits)
            held, size = [], 0
    if held:
        yield pack_cells(held, bits)


def _lists(column: str, bits: int):
    def run(batches):
        yield from pack_all((np.frombuffer(blob, "<u8") for batch in batches for blob in batch.column(column).to_pylist()), bits)

    return run


def _fold(bits: int, least: int):
    width = bits // SLICES

    def run(batches):
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                s = row["slice"]
                if s not in once:
                    once[s], twice[s] = np.zeros(width, bool), np.zeros(width, bool)
                cells = unpack_gaps(row["cells"])
                twice[s][cells] |= once[s][cells] | np.unpackbits(np.frombuffer(row["again"], np.uint8), count=len(cells)).astype(bool)
                once[s][cells] = True
        for s, bitmap in (twice if least == 2 else once).items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(np.packbits(bitmap).tobytes(), 1)], pa.binary())], ["slice", "bitmap"])

    return run


def key_filter(table: DataFrame, column: str, least: int, bits: int = BITS):
    """The bitmap as a broadcast of ``bits / 8`` bytes."""
    return fold_filter(table.select(column).mapInArrow(_lists(column, bits), LISTS), least, bits)


def fold_filter(lists: DataFrame, least: int, bits: int = BITS):
    """The same from lists of cells that tasks have made with ``pack_cells``."""
    maps = lists.repartition(SLICES, "slice").mapInArrow(_fold(bits, least), "slice int, bitmap binary")
    out, size = np.zeros(bits // 8, np.uint8), bits // 8 // SLICES
    rows = maps.collect()  # SLICES rows of at most a fixed size
    while rows:
        row = rows.pop()
        out[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(zlib.decompress(row["bitmap"]), np.uint8)
    return lists.sparkSession.sparkContext.broadcast(out)


def passes(bitmap: np.ndarray, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    cells = cells_of(keys, bits)
    return (bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
