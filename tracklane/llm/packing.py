"""Sequence packing by best-fit decreasing.

A document's ids are cut into full windows first; each full window is a sequence of its own. What is left of a
document, always shorter than a window, is placed into the open window whose remaining capacity fits it tightest. Open
windows are found in a segment tree indexed by remaining capacity, so a placement takes log2(window) steps however
many windows are open.

Tokens never leave the task that makes them: a task keeps five numbers a piece. Pieces are packed in pools of at most
POOL rests, within their input partition, so nothing is shuffled and memory is bounded; a pool's padding is that of its
last few windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracklane.llm.common import batches, text_of
from tracklane.llm.tokens import Encoder

WINDOW = 2048
END_ID = 1
POOL = 500_000

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity: the tightest one that still holds a piece, in log2(size) steps.

    A segment tree over capacities 0..size counts the open windows of each; a query walks up to the first non-empty
    subtree to the right and down its left edge.
    """

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        i = capacity + self.width
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) with the least capacity of at least `need`."""
        i = need + self.width
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.width
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.at[capacity].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[tuple[int, int]], int]:
    """(sequence, offset) of each piece, in the given order, and the number of sequences. Ties keep their order."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    free, used = OpenWindows(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[i])
        capacity, at = found or (window, used)
        used += found is None
        placed[i] = (at, window - capacity)
        if capacity > lengths[i]:
            free.add(capacity - lengths[i], at)
    return placed, used


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, pool: int = POOL) -> DataFrame:
    """One row per piece of each document (columns doc_id, text); ids are those of `tokenizer`, then `end_id`.

    Null or empty texts are the end id alone. Null doc_ids and repeated rows are packed like any other row. No rows:
    no pieces. Other columns are ignored. sequence_id is unique and is the same if a task is run again.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        base = TaskContext.get().partitionId() << 32
        rests: list[tuple] = []

        def flush() -> Iterator[tuple]:
            nonlocal base
            placed, used = best_fit([r[2] for r in rests], window)
            for r, (s, at) in zip(rests, placed):
                yield (*r, base + s, at)
            base += used
            rests.clear()

        def pieces() -> Iterator[tuple]:
            nonlocal base
            for doc, ids in encoder.documents(rows):
                ids = np.append(ids, end_id).astype("<u4")
                n = len(ids)
                full = n - n % window
                for at in range(0, full, window):
                    yield doc, at, window, zlib.crc32(ids[at:at + window]), n, base, 0
                    base += 1
                if full < n:
                    rests.append((doc, full, n - full, zlib.crc32(ids[full:]), n))
                if len(rests) >= pool:
                    yield from flush()
            yield from flush()

        yield from batches(pieces(), PIECES)

    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, SCHEMA)
