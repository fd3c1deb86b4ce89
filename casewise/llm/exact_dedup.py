"""Exact deduplication behind a two-pass Bloom filter.

Pass one folds the digests of all texts into a partitioned Bloom filter that tells cells touched once from cells touched at
least twice. Pass two tests every row against the second kind: a row with a cell that nobody else touched is certainly unique
and passes straight through; only the others, possibly repeated, are shuffled and grouped by their full digest.

The filter has a fixed size (``filter_bits``), whatever the input, so what is broadcast is bounded by ``filter_bits / 8`` bytes.
A filter that is too small for its input lets more unique rows take the shuffle; the result is the same.

Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the largest id
stays, of fully equal rows any one; a null id is smaller than all others. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from casewise.llm.common import ascii_lower, cut, fresh

FILTER_BITS = 1 << 27
WAYS = 4
SLICES = 64
FLUSH_CELLS = 1 << 20
LARGE_SHARE = 1000


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _cells(digests, bits: int) -> np.ndarray:
    """One cell of each of the ``WAYS`` parts of the filter for every digest: shape (rows, WAYS)."""
    words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)
    part = bits // WAYS
    return (words % np.uint64(part) + np.arange(WAYS, dtype=np.uint64) * np.uint64(part)).astype(np.int64)


def _fold_cells(column: str, bits: int):
    width = bits // SLICES

    def packed(chunks):
        cells, counts = np.unique(np.concatenate(chunks), return_counts=True)
        cuts = np.searchsorted(cells, np.arange(SLICES + 1) * width)
        rows = [(s, (cells[a:b] - s * width).astype("<u4").tobytes(), np.packbits(counts[a:b] > 1).tobytes())
                for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                          ["slice", "cells", "again"])

    def run(batches):
        chunks, held = [], 0
        for batch in batches:
            if batch.num_rows:
                chunks.append(_cells(batch.column(column).to_pylist(), bits).ravel())
                held += len(chunks[-1])
            if held >= FLUSH_CELLS:
                yield packed(chunks)
                chunks, held = [], 0
        if chunks:
            yield packed(chunks)

    return run


def _merge_cells(bits: int):
    """Streams cell lists into bitmaps; a task holds two bits for each cell of its slices and nothing else."""
    width = bits // SLICES

    def run(batches):
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                s = row["slice"]
                if s not in once:
                    once[s], twice[s] = np.zeros(width, bool), np.zeros(width, bool)
                cells = np.frombuffer(row["cells"], "<u4")
                again = np.unpackbits(np.frombuffer(row["again"], np.uint8), count=len(cells)).astype(bool)
                twice[s][cells] |= once[s][cells] | again
                once[s][cells] = True
        for s, bitmap in twice.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bitmap).tobytes()], pa.binary())], ["slice", "twice"])

    return run


def repeated_filter(digests: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of the cells touched at least twice; ``bits / 8`` bytes."""
    if bits % (8 * SLICES * WAYS):
        raise ValueError(f"filter_bits must be a multiple of {8 * SLICES * WAYS}")
    lists = digests.select(column).mapInArrow(_fold_cells(column, bits), "slice int, cells binary, again binary")
    maps = lists.repartition(SLICES, "slice").mapInArrow(_merge_cells(bits), "slice int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    size = bits // 8 // SLICES
    for row in maps.collect():  # SLICES rows of a fixed size
        out[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row["twice"], np.uint8)
    return out


def maybe_repeated(digests: DataFrame, column: str, bits: int = FILTER_BITS) -> Column:
    """A column: may the digest occur more than once? Never false for one that does."""
    shared = digests.sparkSession.sparkContext.broadcast(repeated_filter(digests, column, bits).tobytes())

    def test(values: pd.Series) -> pd.Series:
        bitmap = np.frombuffer(shared.value, np.uint8)
        cells = _cells(values, bits)
        hit = (bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=1))

    return F.pandas_udf(test, BooleanType())(F.col(column))


def duplicate_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: its key, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    rows = cut(docs.select(F.col(key).alias("id"), digest(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    marked = rows.withColumn("maybe", maybe_repeated(rows, "digest", filter_bits))
    alone = marked.filter(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    some = marked.filter("maybe").select("id", "digest", "row")
    groups = some.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # Groups of a thousandth of all rows or more: at most a thousand, so they may be broadcast; their rows don't meet in one task.
    large = F.broadcast(groups.filter(F.col("group_size") * LARGE_SHARE >= rows.count()))
    joined = some.join(large, "digest").unionByName(some.join(large, "digest", "left_anti").join(groups, "digest"))
    grouped = joined.select(
        "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest")
    return alone.unionByName(grouped).select(
        F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` without the repeated texts, columns unchanged. Rows of one text are cut to one before they shuffle."""
    name, place, flag = fresh(docs, "_digest"), fresh(docs, "_place"), fresh(docs, "_maybe")
    rows = docs.withColumn(name, digest(F.col(text)))
    marked = rows.withColumn(flag, maybe_repeated(rows, name, filter_bits))
    order = Window.partitionBy(name).orderBy(F.col(key).desc_nulls_last())
    first = marked.filter(flag).withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    return marked.filter(~F.col(flag)).select(*docs.columns).unionByName(first.select(*docs.columns))
