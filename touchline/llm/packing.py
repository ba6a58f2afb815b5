"""Packing of token ids into windows by the online sum-of-squares rule.

A document is its ids and an end id.  Whole windows are cut off its front; the rest, shorter
than a window, is placed online: N[h] counts the open windows filled to level h, and
of all levels with room (and a new window) the one is taken that makes the sum of N[h]^2
over partly filled windows least, the fullest on ties.  The level array is the only search
structure, one numpy step per document.

Each partition of the input packs its own rows, in order, so there is no shuffle and
a lost task is simply run again.  When a partition ends, its open windows are closed: the
least filled ones are cut up into the gaps of the fullest, so at most one window of a
partition is padded.  sequence_id is the partition's number times 2^33 plus a counter.

Defined cases: a null text is empty, so its document is the end id alone; null and
repeated doc_ids are packed like any other row; an empty table gives no pieces; further
columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import default_path, encoder, slices
from .store import read_columns

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SLICE, SLICE_BYTES = 2048, 64 << 20  # documents, and bytes of their texts, encoded at once: more repeats of a piece per look-up


class SumOfSquares:
    """Open windows by fill level, and the choice of a level for each new piece."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # N[h]; N[0] and N[capacity] stay nought
        self.open: list[list[int]] = [[] for _ in range(capacity)]  # windows at each level, by number

    def level(self, size: int) -> int:
        """The level to put a piece of ``size`` on; 0 is a new window."""
        room = self.capacity - size
        n = self.count
        # moving a window from h to h + size changes the sum by 2 (N[h + size] - N[h]) + 2,
        # filling one up by 1 - 2 N[h], opening one by 2 N[size] + 1
        change = n[size : self.capacity + 1] - n[: room + 1]
        change = 2 * change + 2
        change[room] -= 1
        change[0] -= 1
        change[1 : room + 1][n[1 : room + 1] == 0] = np.iinfo(np.int64).max
        if room == 0:
            return 0
        return int(room - np.argmin(change[::-1]))

    def take(self, level: int) -> int:
        self.count[level] -= 1
        return self.open[level].pop()

    def give(self, level: int, window: int) -> None:
        if level < self.capacity:
            self.count[level] += 1
            self.open[level].append(window)


class Packer:
    """Packs documents of one partition; ``pieces`` are rows of the result without ids."""

    def __init__(self, first_sequence: int, capacity: int = WINDOW):
        self.capacity = capacity
        self.levels = SumOfSquares(capacity)
        self.next = first_sequence
        self.waiting: dict[int, list[tuple]] = {}  # pieces of open windows

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        """Pieces of windows that this document fills: (doc_id, start, ids, doc_tokens, sequence, offset)."""
        out, n = [], len(ids)
        whole = n - n % self.capacity
        for at in range(0, whole, self.capacity):
            out.append((doc_id, at, ids[at : at + self.capacity], n, self.next, 0))
            self.next += 1
        size = n - whole
        if size:
            level = self.levels.level(size)
            if level:
                window = self.levels.take(level)
            else:
                window, self.next = self.next, self.next + 1
                self.waiting[window] = []
            self.waiting[window].append((doc_id, whole, ids[whole:].copy(), n, window, level))
            if level + size == self.capacity:
                out += self.waiting.pop(window)
            self.levels.give(level + size, window)
        return out

    def close(self) -> list[tuple]:
        """The pieces of all open windows, the least filled ones cut into the gaps of the fullest."""
        fill = {w: sum(len(p[2]) for p in pieces) for w, pieces in self.waiting.items()}
        order = sorted(fill, key=lambda w: (fill[w], -w))
        low, high = 0, len(order) - 1
        while low < high:
            source, target = order[low], order[high]
            room = self.capacity - fill[target]
            if not room:
                high -= 1
                continue
            doc_id, start, ids, n, _, offset = self.waiting[source].pop()
            cut = max(0, len(ids) - room)
            if cut:
                self.waiting[source].append((doc_id, start, ids[:cut], n, source, offset))
            moved = len(ids) - cut
            self.waiting[target].append((doc_id, start + cut, ids[cut:], n, target, fill[target]))
            fill[target] += moved
            fill[source] -= moved
            if not fill[source]:
                low += 1
        out = [p for w in order for p in self.waiting[w]]
        self.waiting = {}
        return out


def _rows(pieces: list[tuple]) -> pa.RecordBatch:
    doc, start, ids, n, sequence, offset = zip(*pieces)
    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
    return pa.record_batch([pa.array(c, pa.int64()) for c in (doc, start, [len(x) for x in ids], crc, n, sequence, offset)], names=NAMES)


def _packer(path: str, end_id: int, capacity: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 33, capacity)
        for batch in batches:
            for part in slices(batch, "text", SLICE, SLICE_BYTES):
                ids, lengths = coder.encode(part.column("text"))
                ends, out = np.cumsum(lengths), []
                for doc_id, end, n in zip(part.column("doc_id").to_pylist(), ends, lengths):
                    out += packer.add(doc_id, np.append(ids[end - n : end], np.uint32(end_id)))
                if out:
                    yield _rows(out)
        if not keep:
            coder.clear()
            batch = part = ids = None
            pa.default_memory_pool().release_unused()
        if out := packer.close():
            yield _rows(out)

    return run


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """One row per piece; a map over the partitions of ``docs``, without a shuffle.

    ``keep``: Python workers keep the ids of pieces for their next partition; without it they give that memory back to other work.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packer(path or default_path("byte_bpe_50k.json"), end_id, capacity, keep), SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_columns(spark, sf_dir, "documents", "doc_id", "text"))
