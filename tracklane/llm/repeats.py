"""Bytes that lie in a string of LENGTH bytes which starts more than once anywhere in a corpus.

A sample of suffixes is sorted and the others are merged through it, as in difference-cover suffix sorting. The sample
is chosen by content: of each WINDOW positions in a row the one whose GRAM bytes hash lowest. WINDOW + GRAM - 1 = LENGTH,
so the string that starts at any position p has its own sampled position inside, at the same distance wherever the
string occurs; p's suffix is the bytes up to its sampled position, then that position's suffix. Sampled suffixes are named
by their gram; those of one name are sorted by the bytes that follow, adjacent ones compared for their common prefix,
and for every distance d the suffixes d bytes before a sample are merged by those d bytes and by runs of sampled
suffixes whose common prefix is at least LENGTH - d.

All positions that share a sample are one row. Where the whole stretch of their strings occurs twice, a count by
hash settles them; only one row of each distinct stretch, and only of names that have several, goes on to be sorted.
Names with more distinct stretches than a task should merge are never brought together: their strings become digests
where they lie, which are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import batches, materialize, partitions, text_of

LENGTH = 400
WINDOW = 300
MAX_BLOCK = 100_000
CHUNK = 20_000

SAMPLES = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("at", pa.int32()),
                     ("gram", pa.int64()), ("stretch", pa.int64())])
SAMPLES_DDL = "doc_id long, key long, first int, last int, at int, gram long, stretch long"
CONTEXTS = pa.schema([("gram", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("first", pa.int32()), ("last", pa.int32()),
                      ("alone", pa.bool_()), ("doc_id", pa.int64()), ("key", pa.int64())])
CONTEXTS_DDL = "gram long, right binary, left binary, first int, last int, alone boolean, doc_id long, key long"
STARTS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("digest", pa.binary())])
STARTS_DDL = "doc_id long, key long, low int, high int, digest binary"
KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes at each position."""
    x = data.astype(U64) + U64(1)
    n = len(x)
    powers = np.full(n + 1, BASE, U64)
    powers[0] = 1
    inverse = np.full(n + 1, BASE_INVERSE, U64)
    inverse[0] = 1
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(x * np.cumprod(powers)[:n], dtype=U64)])
    return _mixed((sums[size:] - sums[:-size]) * np.cumprod(inverse)[:n - size + 1])


def _sliding(h: np.ndarray, width: int, best) -> np.ndarray:
    """`best` (minimum or maximum) of each `width` values in a row."""
    done = 1
    while 2 * done <= width:
        h = best(h[:-done], h[done:])
        done *= 2
    return best(h[:len(h) - (width - done)], h[width - done:]) if done < width else h


def samples(data: bytes, length: int = LENGTH, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(first, last, at, gram hash): the leftmost lowest gram among `window` positions from p is at `at` for first <= p <= last."""
    n, size = len(data), length - window + 1
    if n < length:
        return []
    h = gram_hashes(np.frombuffer(data, np.uint8), size)
    low = _sliding(h, window, np.minimum)
    edges = np.concatenate([np.zeros(window - 1, U64), low, np.zeros(window - 1, U64)])
    at = np.flatnonzero(h == _sliding(edges, window, np.maximum))  # lowest in some window
    starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    ends = np.append(starts[1:], len(low)) - 1
    order = np.argsort(h[at], kind="stable")
    values, places = h[at][order], at[order]
    left, right = np.searchsorted(values, low[starts], "left"), np.searchsorted(values, low[starts], "right")
    out = []
    for s, e, a, b in zip(starts.tolist(), ends.tolist(), left.tolist(), right.tolist()):
        if b - a == 1:
            x = int(places[a])
            out.append((s, e, x, int(h[x])))
            continue
        for x in places[a + int(np.searchsorted(places[a:b], s)):b].tolist():
            if s > e:
                break
            out.append((s, min(e, x), x, int(h[x])))
            s = x + 1
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _sampled(docs: DataFrame, length: int, window: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in rows:
                for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                    data = text.encode("utf-8", "surrogatepass")
                    for first, last, at, gram in samples(data, length, window):
                        stretch = xxhash.xxh64_intdigest(data[first:last + length], at - first)
                        yield doc, key, first, last, at, _signed(gram), _signed(stretch)

        yield from batches(each(), SAMPLES)

    return materialize(docs.mapInArrow(run, SAMPLES_DDL), "samples")


def _contexts(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The bytes before and from each chosen sample, as far as the strings that share it reach. Of crowded names a row for
    each string, which has no right part, the string's digest on the left, and a name from the digest."""
    lists = chosen.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "last", "at", "gram", "alone", "crowded")).alias("samples"))
    # rows that repeat a document give its samples once each; none of these is alone, so they settle nothing for themselves
    with_text = lists.join(docs.toDF("_id", "_key", "text"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in rows:
                for doc, key, found, text in zip(*(c.to_pylist() for c in batch.columns)):
                    data = text.encode("utf-8", "surrogatepass")
                    for s in found:
                        if not s["crowded"]:
                            yield (s["gram"], data[s["at"]:s["last"] + length], data[s["first"]:s["at"]], s["first"], s["last"], s["alone"], doc, key)
                            continue
                        for p in range(s["first"], s["last"] + 1):
                            digest = hashlib.blake2b(data[p:p + length], digest_size=16).digest()
                            yield int.from_bytes(digest[:8], "little", signed=True), None, digest, p, p, s["alone"], doc, key

        yield from batches(each(), CONTEXTS, 2000)

    return with_text.select("doc_id", "key", "samples", "text").mapInArrow(run, CONTEXTS_DDL)


def _repeated(lefts: list[bytes], rights: list[bytes], span: list[tuple[int, int]], block: np.ndarray, length: int) -> np.ndarray:
    """For rows sorted by (block, right): which of the strings that start d bytes before the sample occur twice, by (row, d)."""
    m, d_max = len(lefts), max(map(len, lefts))
    low, high = (np.array(x) for x in zip(*span))  # distances of each row
    right_size = max(map(len, rights))
    right = np.frombuffer(b"".join(r.ljust(right_size, b"\0") for r in rights), np.uint8).reshape(m, right_size)
    left = np.frombuffer(b"".join(x[::-1].ljust(d_max + 1, b"\0") for x in lefts), np.uint8).reshape(m, d_max + 1).astype(U64)
    sizes = np.array(list(map(len, rights)))
    equal = right[1:] == right[:-1]
    common = np.where(equal.all(1), right_size, equal.argmin(1))
    common = np.concatenate([[-1], np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))])
    common[1:][block[1:] != block[:-1]] = -1
    out = np.zeros((m, d_max + 1), bool)
    before = np.zeros(m, U64)
    for d in range(d_max + 1):
        rows = np.flatnonzero((low <= d) & (d <= high))
        if len(rows) > 1:
            run, back = np.cumsum(common < length - d)[rows], before[rows]
            order = np.lexsort((back, run))
            run, back = run[order], back[order]
            same = (run[1:] == run[:-1]) & (back[1:] == back[:-1])
            twice = np.zeros(len(rows), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            out[rows[twice], d] = True
        before = (before + left[:, d] + U64(1)) * U64(BASE)
    return out


def _merge(length: int):
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle(rows: list[tuple]) -> Iterator[tuple]:
            if len(rows) < 2:
                return
            names = np.array([r[0] for r in rows])
            # distance to the sample of the last and first string of a row
            span = [(len(r[2]) - (r[4] - r[3]), len(r[2])) for r in rows]
            found = _repeated([r[2] for r in rows], [r[1] for r in rows], span, names, length)
            for i in np.flatnonzero(found.any(1) & np.array([r[5] for r in rows])).tolist():
                r, ds = rows[i], np.flatnonzero(found[i])
                at = r[3] + len(r[2])
                for part in np.split(ds, np.flatnonzero(np.diff(ds) > 1) + 1):
                    yield r[6], r[7], int(at - part[-1]), int(at - part[0]), None

        def each() -> Iterator[tuple]:
            nonlocal held
            for batch in batches_:
                for r in zip(*(c.to_pylist() for c in batch.columns)):
                    if r[1] is None:
                        yield r[6], r[7], r[3], r[4], r[2]
                        continue
                    if held and r[0] != held[-1][0] and len(held) >= CHUNK:
                        yield from settle(held)
                        held = []
                    held.append(r)
            yield from settle(held)

        yield from batches(each(), STARTS)

    return run


def repeated_starts(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, max_block: int = MAX_BLOCK) -> DataFrame:
    """(doc_id, key, low, high): ranges of positions of `docs` (doc_id, key, text) where a repeated string starts.

    key is a hash of the text. Of blocks with more than `max_block` distinct stretches of one name every string is
    counted by its digest instead, which needs no block in one place.
    """
    spark = docs.sparkSession
    sampled = _sampled(docs, length, window)
    stretches = materialize(sampled.groupBy("gram", "stretch").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "first", "last", "at")).alias("x")).where("n > 0"), "stretches")
    whole = sampled.join(stretches.where("n > 1").select("gram", "stretch"), ["gram", "stretch"], "left_semi")
    several = stretches.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    chosen = stretches.join(several, "gram").select("gram", "x.*", (F.col("n") == 1).alias("alone"), (F.col("m") > max_block).alias("crowded"))
    sorted_ = _contexts(docs, chosen, length).repartition(partitions(spark), "gram").sortWithinPartitions("gram", "right")
    merged = materialize(sorted_.mapInArrow(_merge(length), STARTS_DDL), "merged")
    by_digest = merged.where("digest is not null")
    often = by_digest.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return (whole.select("doc_id", "key", F.col("first").alias("low"), F.col("last").alias("high"))
            .unionByName(merged.where("digest is null").drop("digest"))
            .unionByName(by_digest.join(often, "digest", "left_semi").drop("digest")))


def remove(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, max_block: int = MAX_BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of `docs` (doc_id, text).

    Null texts are empty; texts shorter than `length` keep all bytes. Repeated rows are documents of their own and repeat
    each other. Null doc_ids stay. No rows: no rows. Other columns are ignored.
    """
    keyed = docs.select("doc_id", F.xxhash64(text_of("text")).alias("key"), text_of("text").alias("text"))
    ranges = repeated_starts(keyed, length, window, max_block).groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("low", "high")).alias("starts")).toDF("_id", "_key", "starts")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in rows:
                for doc, text, starts in zip(*(c.to_pylist() for c in batch.columns)):
                    data = text.encode("utf-8", "surrogatepass")
                    kept, at, spans = hashlib.sha256(), 0, 0
                    left, end = 0, -1
                    for low, high in sorted((s["low"], s["high"]) for s in starts or ()):
                        if low > end:
                            kept.update(data[at:low])
                            left += low - at
                            spans += 1
                        end = max(end, high + length)
                        at = end
                    kept.update(data[at:])
                    left += len(data) - at
                    yield doc, len(data), len(data) - left, spans, kept.hexdigest()

        yield from batches(each(), KEPT)

    return (keyed.join(ranges, keyed["doc_id"].eqNullSafe(ranges["_id"]) & (keyed["key"] == ranges["_key"]), "left")
            .select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
