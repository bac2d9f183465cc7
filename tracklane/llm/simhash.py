"""SimHash near-duplicates: links of fingerprints that differ in at most three bits, found by deletion variants.

64 bits are cut into two segments. Of three differing bits at most one lies in one of the segments, so two linked
fingerprints share a variant of a segment with one bit masked out: 2 * 32 rows per distinct fingerprint are brought
together by equality of (segment, masked position, masked value) and compared in full. A bucket of more than MAX_BUCKET
fingerprints is not compared pair by pair but handed to a second and third level, where the other segment is cut
and masked in the same way; buckets of the third level hold 2 048 fingerprints at most, whatever the data.

Equal fingerprints are one row throughout, so a group of copies costs as much as one document. Tasks stream sorted
buckets and return a spanning forest of the links they verify, so links of a dense group grow with its size and not
with its square; no two linked fingerprints end up in different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.llm.common import materialize, partitions
from tracklane.llm.components import components

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
MAX_BUCKET = 16_384
BLOCK = 1 << 20

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Width of a segment at each level; rows per fingerprint are twice that.
WIDTHS = (32, 16, 8)
FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Unsigned hashes of the shingles of one text, `size` words each."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(words) < size:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """One signed 64-bit fingerprint a text: bit i is 1 if it is set in over half of the text's hashes."""
    out = np.zeros(len(hashes), np.int64)
    for i, h in enumerate(hashes):
        if len(h):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), BLOCK):
                bits = np.unpackbits(h[at:at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(0, dtype=np.uint32)
            out[i] = np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]
    return out


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    return pd.Series(majority([fingerprint(t) for t in texts]))


def _variants(rows: DataFrame, level: int) -> DataFrame:
    """(k1, k2, fp): each row once for each segment of this level and each masked position in it."""
    w = WIDTHS[level]

    def part(upper: Column, below: Column) -> Column:
        """w bits of fp, from bit `below`, or from bit `below` + w where `upper`."""
        at = (below + F.when(upper, F.lit(w)).otherwise(F.lit(0))).cast("int")
        return F.call_function("shiftrightunsigned", F.col("fp"), at).bitwiseAND(F.lit((1 << w) - 1))

    # which half the earlier levels used up: the rest begins at bit 32 if the lower half was used, and so on
    used = [F.lit(0)] + [F.lit(0)] * level
    if level >= 1:
        v0 = F.call_function("shiftrightunsigned", F.col("k1"), F.lit(32)).bitwiseAND(F.lit(63))
        used[1] = F.when(v0 >= 32, F.lit(32)).otherwise(F.lit(0))
    if level >= 2:
        v1 = F.call_function("shiftrightunsigned", F.col("k2"), F.lit(16)).bitwiseAND(F.lit(31))
        used[2] = used[1] + F.when(v1 >= 16, F.lit(16)).otherwise(F.lit(0))
    v = F.col("v")
    masked = part(v < w, used[level]).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (v % w).cast("int")).bitwiseXOR(F.lit(-1)))
    tagged = F.call_function("shiftleft", v.cast("long"), F.lit(w)).bitwiseOR(masked)
    keep = {0: (tagged, F.lit(0).cast("long")), 1: (F.col("k1"), tagged),
            2: (F.col("k1"), F.call_function("shiftleft", F.col("k2"), F.lit(12)).bitwiseOR(tagged))}[level]
    exploded = rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(2 * w - 1))))
    return exploded.select(keep[0].alias("k1"), keep[1].alias("k2"), "fp")


def _linked(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Within MAX_DISTANCE, and met in the first place where they meet: v numbers the segment and masked bit of level 0."""
    x = a ^ b
    near = np.bitwise_count(x) <= MAX_DISTANCE
    shift = np.where(v < 32, np.uint64(32), np.uint64(0))
    seg = (x >> shift) & np.uint64(0xFFFFFFFF)
    at = (v % 32).astype(np.uint64)
    return near & ((seg == np.uint64(1) << at) | ((seg == 0) & (at == 0)))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: each node to the smallest node it is connected to."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[:len(u)], ends[len(u):]
    name = np.arange(len(nodes))
    while True:
        low = np.minimum(name[a], name[b])
        new = name.copy()
        np.minimum.at(new, name[a], low)
        np.minimum.at(new, name[b], low)
        new = new[new]
        if np.array_equal(new, name):
            break
        name = new
    far = name != np.arange(len(nodes))
    return nodes[far], nodes[name[far]]


def _bucket_pairs(fp: np.ndarray, v: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one large bucket: across the masked bit, and for masked bit 0 also on either side of it."""
    bit = np.uint64((v % 32) + (32 if v < 32 else 0))
    side = (fp >> bit) & np.uint64(1) == 1
    pairs = [(fp[side], fp[~side])] + ([(fp[side], fp[side]), (fp[~side], fp[~side])] if v % 32 == 0 else [])
    for left, right in pairs:
        if not len(left) or not len(right):
            continue
        step = max(1, BLOCK // len(right))
        for at in range(0, len(left), step):
            i, j = np.nonzero(np.bitwise_count(left[at:at + step, None] ^ right[None, :]) <= MAX_DISTANCE)
            a, b = left[at:at + step][i], right[j]
            yield a[a != b], b[a != b]


def _compare(last: bool, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_u, held_v, size = [], [], 0

        def row(u=None, v=None, k1=None, k2=None, fp=None) -> pa.RecordBatch:
            n = len(u if u is not None else fp)
            cols = [pa.nulls(n, pa.int64()) if c is None else pa.array(np.asarray(c).view(np.int64)) for c in (u, v, k1, k2, fp)]
            return pa.RecordBatch.from_arrays(cols, schema=FOUND)

        def keep(u: np.ndarray, v: np.ndarray) -> None:
            nonlocal size
            if len(u):
                held_u.append(u)
                held_v.append(v)
                size += len(u)
            if size > 4 * BLOCK:
                shrink()

        def shrink() -> None:
            nonlocal size
            u, v = forest(np.concatenate(held_u), np.concatenate(held_v))
            held_u[:], held_v[:], size = [u], [v], len(u)

        def groups(k1, k2, fp) -> Iterator[pa.RecordBatch]:
            """Whole buckets, in order."""
            cut = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            starts = np.concatenate([[0], cut])
            sizes = np.diff(np.concatenate([starts, [len(k1)]]))
            small = np.repeat((sizes > 1) & (sizes <= 32), sizes)
            a, b, f = k1[small], k2[small], fp[small]
            v = (a >> 32) & 63
            for d in range(1, 32):
                same = (a[:-d] == a[d:]) & (b[:-d] == b[d:]) if len(a) > d else np.zeros(0, bool)
                if not same.any():
                    break
                i = np.flatnonzero(same)
                i = i[_linked(f[i], f[i + d], v[i])]
                keep(f[i], f[i + d])
            for g in np.flatnonzero(sizes > 32):
                part = slice(starts[g], starts[g] + sizes[g])
                if sizes[g] > most and not last:
                    yield row(k1=k1[part], k2=k2[part], fp=fp[part])
                else:
                    for u, w in _bucket_pairs(fp[part], int((k1[starts[g]] >> 32) & 63)):
                        keep(u, w)

        rest: list[np.ndarray] | None = None
        big = None  # the bucket that is handed on while its rows go by
        for batch in batches:
            k1, k2, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.view(np.uint64)
            if big is not None:
                n = int(np.argmin(np.append((k1 == big[0]) & (k2 == big[1]), False)))
                if n:
                    yield row(k1=k1[:n], k2=k2[:n], fp=fp[:n])
                k1, k2, fp = k1[n:], k2[n:], fp[n:]
                if not len(k1):
                    continue
                big = None
            if rest is not None:
                k1, k2, fp = (np.concatenate([r, c]) for r, c in zip(rest, (k1, k2, fp)))
                rest = None
            if not len(k1):
                continue
            start = int(np.argmax((k1 == k1[-1]) & (k2 == k2[-1])))
            if start:
                yield from groups(k1[:start], k2[:start], fp[:start])
            if len(k1) - start > most and not last:
                big = (k1[-1], k2[-1])
                yield row(k1=k1[start:], k2=k2[start:], fp=fp[start:])
            else:
                rest = [k1[start:], k2[start:], fp[start:]]
        if rest is not None:
            yield from groups(*rest)
        if size:
            shrink()
            yield row(u=held_u[0], v=held_v[0])

    return run


def links(fingerprints: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp: long) that connect just those within MAX_DISTANCE of each other."""
    spark = fingerprints.sparkSession
    rows, found = fingerprints.where("fp is not null").select("fp"), None
    for level in range(len(WIDTHS)):
        keyed = _variants(rows, level).repartition(partitions(spark), "k1", "k2").sortWithinPartitions("k1", "k2")
        out = materialize(keyed.mapInArrow(_compare(level == len(WIDTHS) - 1, max_bucket), "u long, v long, k1 long, k2 long, fp long"), "near")
        these = out.where("u is not null").select("u", "v")
        found = these if found is None else found.unionByName(these)
        rows = out.where("u is null").select("k1", "k2", "fp")
        if level == len(WIDTHS) - 1 or rows.isEmpty():
            break
    return found


def classes(prints: DataFrame) -> DataFrame:
    """(fp, label, first, component_id) of each distinct fingerprint of `prints` (doc_id, fp).

    label is the smallest fingerprint of the class, first the smallest doc_id of the fingerprint, component_id that of
    the class; nulls count only where there is no other.
    """
    each = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    named = materialize(components(links(each)), "components")
    each = each.join(named.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = each.groupBy("label").agg(F.min("first").alias("component_id"))
    return each.join(least, "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of `docs` (doc_id, text).

    Null and blank texts have fingerprint zero and are linked like others. A repeated row is a copy. A null doc_id is
    in its class, but never its id unless no other is there. No rows: no rows.
    """
    prints = materialize(docs.select("doc_id", simhash("text").alias("fp")), "simhash")
    return prints.join(classes(prints).select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each class: that with the smallest doc_id; of repeated rows any one."""
    marked = docs.withColumn("_fp", simhash("text"))
    found = materialize(classes(marked.select("doc_id", F.col("_fp").alias("fp"))), "classes")
    # the fingerprint that holds the class's smallest doc_id; of several (a repeated doc_id) the smallest
    chosen = found.where(F.col("first").eqNullSafe(F.col("component_id"))).groupBy("label").agg(
        F.min("fp").alias("_fp"), F.min("component_id").alias("_first"))
    kept = marked.join(chosen.select("_fp", "_first"), "_fp").where(F.col("doc_id").eqNullSafe(F.col("_first")))
    return kept.dropDuplicates(["_fp"]).select(*docs.columns)
