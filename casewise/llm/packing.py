"""Packing documents into training sequences of equal attention cost.

A document is its token ids and one end id. Each task packs the documents it reads, in rounds of about ``ROUND_TOKENS``
tokens: documents longer than a sequence give whole sequences first; what is left, in descending order, goes to the sequence of the
lowest estimated cost (``LINEAR`` per token plus ``QUADRATIC`` per squared piece length: attention stays within a piece) among those
with room for it. A piece that fits nowhere whole is cut to fill the cheapest sequence that has room. A round opens
only as many sequences as its tokens fill; what remains is carried to the next round. So a task pads less than one sequence in all.

No row is shuffled, and a task holds one round. Sequence ids are the task's number times 2^40 plus a count, so they don't depend on other
tasks and a repeated task gives the same ones as long as its input rows are the same.

Null texts count as empty: such a document is its end id alone. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from casewise.llm.bpe import shared_codec, texts_of

CAPACITY = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
ROUND_TOKENS = 2_000_000
TASK_STRIDE = 1 << 40
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(length):
    """Estimated cost of attending over a piece."""
    return LINEAR * length + QUADRATIC * length * length


def balance(lengths: list[int], bins: int, capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Deal items out to ``bins`` sequences.

    Returns the pieces (item, start in it, length, bin), in the order in which they enter the bins, and the rest that had no room
    (item, start, length). Ties go to the longer item first, then to the earlier one, then to the smaller bin."""
    room, load = [capacity] * bins, [0.0] * bins
    rooms, loads = np.full(bins, capacity), np.zeros(bins)  # the same for looks at all sequences, which only cut documents need
    # Sequences by load; those without room for the present item wait, by room, for shorter ones. What was outdated by a later piece is passed over.
    ready, waiting = [(0.0, b) for b in range(bins)], []
    placed, rest = [], []

    def cheapest(least: int) -> int:
        fits = rooms >= least
        return int(np.where(fits, loads, np.inf).argmin()) if fits.any() else -1

    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while waiting and -waiting[0][0] >= left:
            r, b = heappop(waiting)
            if room[b] == -r:
                heappush(ready, (load[b], b))
        while left:
            b = -1
            if start:
                b = cheapest(left)
            else:
                while ready and b < 0:
                    known, c = ready[0]
                    if known == load[c] and room[c] >= left:
                        b = c
                    else:
                        heappop(ready)
                        if known == load[c]:
                            heappush(waiting, (-room[c], c))
            if b < 0:
                b = cheapest(1)
                if b < 0:
                    rest.append((item, start, left))
                    break
            size = min(left, room[b])
            placed.append((item, start, size, b))
            room[b] -= size
            load[b] += cost(size)
            rooms[b], loads[b] = room[b], load[b]
            heappush(ready, (load[b], b))
            start, left = start + size, left - size
    return placed, rest


class _Packer:
    """The state of one task. Items are (row, ids, start in the document)."""

    def __init__(self, first_sequence: int, capacity: int):
        self.next, self.capacity = first_sequence, capacity
        self.items: list[tuple[tuple, np.ndarray, int]] = []
        self.tokens = 0
        self.out: list[tuple] = []

    def add(self, row, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._emit(row, ids, start, self.capacity, self.next, 0)
            self.next += 1
        if whole < len(ids):
            self.items.append((row, ids, whole))
            self.tokens += len(ids) - whole

    def _emit(self, row, ids, start, size, sequence, offset) -> None:
        piece = ids[start : start + size]
        self.out.append((row, start, size, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), sequence, offset))

    def close_round(self, last: bool) -> None:
        bins = -(-self.tokens // self.capacity) if last else self.tokens // self.capacity
        if not bins:
            return
        placed, rest = balance([len(ids) - start for _, ids, start in self.items], bins, self.capacity)
        filled = [0] * bins
        for item, start, size, b in placed:
            row, ids, first = self.items[item]
            self._emit(row, ids, first + start, size, self.next + b, filled[b])
            filled[b] += size
        self.next += bins
        self.items = [(self.items[i][0], self.items[i][1], self.items[i][2] + start) for i, start, _ in rest]
        self.tokens = sum(size for _, _, size in rest)

    def flush(self, key_type, key: str) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [()] * 7
        self.out = []
        arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
        return pa.RecordBatch.from_arrays(arrays, [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the document's key, where the piece starts and how long it is, its checksum, and its sequence and offset there."""
    codec = shared_codec(docs.sparkSession, path)

    def run(batches):
        packer, key_type = _Packer(TaskContext.get().partitionId() * TASK_STRIDE, capacity), pa.int64()
        for batch in batches:
            names = batch.column("key")
            for name, ids in zip(names, codec().encode_all(texts_of(batch, "text"))):
                packer.add(name.as_py(), np.append(ids, np.uint16(END_ID)))
                if packer.tokens >= ROUND_TOKENS:
                    packer.close_round(False)
                    yield packer.flush(key_type, key)
        packer.close_round(True)
        yield packer.flush(key_type, key)

    narrow = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return narrow.mapInArrow(run, f"`{key}` long, {SCHEMA}")
