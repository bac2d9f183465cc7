"""Periodic runs of words, found by recursive frequency splitting.

A run of period q and at least max(6, 4 q) words holds each of its words four times or more. So a word that occurs fewer
than four times in a segment is in no run there and splits it; what is left is counted again, piece by piece, until nothing
splits. This goes on for all documents of a batch at once, as arrays of word numbers. Each surviving segment is scanned by
lags: of a run with period q, every q-th word from any start is the same word, so only stretches where four words of a grid
of step q are equal are compared in full, which takes about n log n steps in a segment of n words.

A document is looked at in one piece, since its longest run may span it; tasks hold one batch of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import text_of

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of a batch that are counted together.
BATCH_WORDS = 1 << 20

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("period", pa.int64()), ("exponent_milli", pa.int64()), ("n_dropped", pa.int64()), ("runs", pa.string()),
    ("collapsed", pa.string())])
DDL = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
       "n_dropped long, runs string, collapsed string")


Repeat = Callable[[int, int], tuple[int, int] | None]


class Run(NamedTuple):
    start: int
    length: int
    period: int


def segments(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of `words` (numbers) inside the given ones, in which every word occurs LEAST_PERIODS times or more."""
    done_starts, done_ends = [], []
    while len(starts):
        long = ends - starts >= LEAST_WORDS
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        size = ends - starts
        segment = np.repeat(np.arange(len(size)), size)
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key = segment * (int(words.max()) + 1) + words[at]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        first = np.flatnonzero(np.diff(sorted_key, prepend=-1))
        many = np.diff(first, append=len(key))
        rare = np.empty(len(key), bool)
        rare[order] = np.repeat(many < LEAST_PERIODS, many)
        split = np.zeros(len(size), bool)
        split[segment[rare]] = True
        done_starts.append(starts[~split])
        done_ends.append(ends[~split])
        # what lies between rare words of a segment is looked at again
        keep = ~rare & split[segment]
        before = np.concatenate([[False], keep[:-1] & (segment[1:] == segment[:-1])])
        after = np.concatenate([keep[1:] & (segment[1:] == segment[:-1]), [False]])
        starts, ends = at[keep & ~before], at[keep & ~after] + 1
    if not done_starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts, ends = np.concatenate(done_starts), np.concatenate(done_ends)
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def _same(w: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from `a` and `b` on are pairwise equal, going by `step` (1 or -1)."""
    count, size = 0, 64
    while True:
        room = min(size, (len(w) - b) if step > 0 else a + 1)
        if room <= 0:
            return count
        x, y = (w[a:a + room], w[b:b + room]) if step > 0 else (w[a - room + 1:a + 1][::-1], w[b - room + 1:b + 1][::-1])
        differ = x != y
        k = int(differ.argmax())
        if differ[k]:
            return count + k
        count, a, b, size = count + room, a + step * room, b + step * room, size * 2


def scan_lags(w: np.ndarray) -> list[Run]:
    """All runs of one segment, smallest periods of equal stretches only."""
    found: dict[tuple[int, int], int] = {}
    # period and end of a run already found at each word: stretches of its multiples are that run again
    period, until = np.full(len(w), len(w) + 1), np.zeros(len(w), np.int64)
    for q in range(1, len(w) // LEAST_PERIODS + 1):
        grid = w[::q]
        equal = grid[1:] == grid[:-1]
        at = np.flatnonzero(equal[2:] & equal[1:-1] & equal[:-2]) * q
        if len(at):
            at = at[(q % period[at] != 0) | (until[at] <= at + 3 * q)]
        # between a grid word and the next all words equal those a period on
        for j in (1, 2, 3, 5, 8, 13, 21):
            if j >= q or not len(at):
                break
            at = at[w[at + j] == w[at + j + q]]
        seen = -1
        for k in at.tolist():
            if k + q < seen:
                continue
            right = _same(w, k, k + q, 1)
            if right < q:
                continue
            start, end = k - _same(w, k - 1, k + q - 1, -1), k + right + q
            seen = end
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q) and (start, end) not in found:
                found[start, end] = q
                period[start:end], until[start:end] = q, end
    return sorted(Run(s, e - s, q) for (s, e), q in found.items())


def runs_of(numbers: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each of several sequences of word numbers, by start, then period."""
    size = np.array([len(x) for x in numbers], np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    out: list[list[Run]] = [[] for _ in numbers]
    if not len(ends) or not ends[-1]:
        return out
    words = np.concatenate(numbers)
    for s, e in zip(*(x.tolist() for x in segments(words, starts, ends))):
        doc = int(np.searchsorted(ends, s, "right"))
        out[doc].extend(Run(r.start + s - int(starts[doc]), r.length, r.period) for r in scan_lags(words[s:e]))
    return [sorted(x, key=lambda r: (r.start, r.period)) for x in out]


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """True for words of a run after its first period."""
    out = np.zeros(n, bool)
    for r in runs:
        out[r.start + r.period:r.start + r.length] = True
    return out


def _rows(doc_ids: list, texts: list[bytes], repeat: Repeat | None) -> pa.RecordBatch:
    number: dict[bytes, int] = {}
    words = [t.split() for t in texts]  # of bytes: at ASCII white space only
    for i, (doc, w) in enumerate(zip(doc_ids, words)):
        shift = repeat(doc, len(w)) if repeat and w and doc is not None else None
        if shift:
            a, p = shift
            words[i] = w[:a] + [w[a + k % p] for k in range(len(w) - a)]
    numbers = [np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w)) for w in words]
    rows = []
    for doc, w, runs in zip(doc_ids, words, runs_of(numbers)):
        drop = dropped(len(w), runs) if runs else None
        kept = w if drop is None else [x for x, d in zip(w, drop.tolist()) if not d]
        best = min(runs, key=lambda r: (-r.length, r.start, r.period)) if runs else None
        rows.append((doc, len(w), len(runs), *((*best, 1000 * best.length // best.period) if best else (None,) * 4),
                     len(w) - len(kept), "".join("%d,%d,%d\n" % r for r in runs), b" ".join(kept)))
    columns = list(zip(*rows)) if rows else [()] * len(SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) if f.name != "collapsed" else pa.array(list(c), pa.binary()).cast(
        pa.string()) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def find(docs: DataFrame, repeat: Repeat | None = None) -> DataFrame:
    """doc_id, n_words, the runs of each row's text, its longest run and the text without repetitions.

    Words are what ASCII white space separates. `runs` has a line `start,length,period` per run; `start`, `length`, `period`
    and `exponent_milli` are those of the longest (ties: smallest start, then period) or null; `collapsed` has one space
    between the words that are left when each run keeps its first period.
    `repeat(doc_id, n)`, n being the number of words, gives (a, p) to make word i >= a the word a + (i - a) mod p before the
    search, or None; rows without words or doc_id are not asked.

    Null texts are empty, empty and blank texts have no runs and an empty `collapsed`. Repeated rows and null doc_ids are
    rows of their own. No rows: no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids, texts = b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()
            first = size = 0
            for i, t in enumerate(texts):
                size += len(t) // 6
                if size >= BATCH_WORDS or i == len(texts) - 1:
                    yield _rows(doc_ids[first:i + 1], texts[first:i + 1], repeat)
                    first, size = i + 1, 0

    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, DDL)


def digest(found: DataFrame) -> DataFrame:
    """`find` with digests in place of its texts."""
    return found.select(*[c for c in found.columns if c not in ("runs", "collapsed")], F.sha2("runs", 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
