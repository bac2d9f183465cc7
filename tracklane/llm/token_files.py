"""Token-id files: ids of whole texts in ascending doc_id order, entropy-coded, written and read by tasks.

A file holds whole documents: a table of frequencies that all its blocks share, its documents (id, number of ids), and
blocks of range-coded ids with checkpoints. Table, documents and each block carry a checksum; each block carries one
of its decoded ids as well. A file ends after MAX_IDS ids, which bounds the memory of the tasks on either side.
Files are found through rows returned by the tasks that wrote them, kept as a table in the shared folder: a task that
is run again leaves a file that nobody reads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm import rans
from tracklane.llm.common import batches, fresh_dir, materialize, open_in, open_out, partitions, prefix_total, text_of
from tracklane.llm.tokens import Encoder

MAGIC = b"TLRANS01"
MAX_IDS = 1 << 24
END_ID = 0

FILES = pa.schema([("part", pa.int64()), ("before_in_part", pa.int64()), ("n_ids", pa.int64()), ("uri", pa.string())])
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                  ("file", pa.string())])


class Damaged(ValueError):
    """A file or block whose checksum does not hold."""


class TokenFile(NamedTuple):
    """doc_ids may hold None; `ids` are those of all documents in a row."""

    doc_ids: list[int | None]
    lengths: np.ndarray
    ids: np.ndarray


def _section(data: bytes) -> bytes:
    return struct.pack("<QI", len(data), zlib.crc32(data)) + data


def _take(f) -> bytes:
    head = f.read(12)
    if len(head) < 12:
        raise Damaged("file ends early")
    n, crc = struct.unpack("<QI", head)
    data = f.read(n)
    if len(data) != n or zlib.crc32(data) != crc:
        raise Damaged("checksum of a section does not hold")
    return data


def write_file(out, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
    """`out` needs write(); `ids` are unsigned 32-bit."""
    table = rans.make_table(ids)
    blocks = rans.encode(ids, table)
    out.write(MAGIC)
    out.write(_section(struct.pack("<QQQ", len(doc_ids), len(ids), len(blocks))))
    gaps = np.diff(table.symbols.astype(np.int64), prepend=0)
    out.write(_section(zlib.compress(gaps.astype("<u4").tobytes() + table.freqs.astype("<u4").tobytes())))
    known = np.array([d is not None for d in doc_ids], bool)
    steps = np.diff(np.array([d or 0 for d in doc_ids], np.int64), prepend=0)
    out.write(_section(zlib.compress(np.packbits(known).tobytes() + steps.astype("<i8").tobytes()
                                     + np.array(lengths, "<u8").tobytes())))
    at = 0
    for b in blocks:
        crc = zlib.crc32(ids[at:at + b.n].astype("<u4"))
        at += b.n
        out.write(_section(struct.pack("<QIII", b.n, len(b.positions), len(b.words), crc) + b.positions.astype("<u4").tobytes()
                           + b.states.astype("<u8").tobytes() + b.words.astype("<u4").tobytes()))


def read_file(f) -> TokenFile:
    """`f` needs read(n). Raises Damaged where a checksum does not hold."""
    if f.read(len(MAGIC)) != MAGIC:
        raise Damaged("not a token file")
    n_docs, n_ids, n_blocks = struct.unpack("<QQQ", _take(f))
    raw = np.frombuffer(zlib.decompress(_take(f)), "<u4")
    half = len(raw) // 2
    table = rans.Table(np.cumsum(raw[:half].astype(np.int64)).astype(np.uint32), raw[half:].astype(np.int64))
    raw = zlib.decompress(_take(f))
    bits = -(-n_docs // 8)
    known = np.unpackbits(np.frombuffer(raw[:bits], np.uint8), count=n_docs)
    doc_ids = np.cumsum(np.frombuffer(raw[bits:bits + 8 * n_docs], "<i8"))
    lengths = np.frombuffer(raw[bits + 8 * n_docs:], "<u8").astype(np.int64)
    blocks, sums = [], []
    for _ in range(n_blocks):
        raw = _take(f)
        n, points, words, crc = struct.unpack("<QIII", raw[:20])
        cut = 20 + 4 * points
        end = cut + 8 * points * rans.LANES
        blocks.append(rans.Block(n, np.frombuffer(raw[20:cut], "<u4").astype(np.int64),
                                 np.frombuffer(raw[cut:end], "<u8").reshape(points, rans.LANES).astype(np.uint64),
                                 np.frombuffer(raw[end:], "<u4", words)))
        sums.append(crc)
    ids = rans.decode(blocks, table)
    for got, crc in zip(ids, sums):
        if zlib.crc32(got.astype("<u4")) != crc:
            raise Damaged("checksum of a block's ids does not hold")
    ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    if len(ids) != n_ids or lengths.sum() != n_ids:
        raise Damaged("number of ids does not hold")
    return TokenFile([int(d) if k else None for d, k in zip(doc_ids, known)], lengths, ids)


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write the ids of all documents (doc_id, text), `end_id` after each, and return the files as a stored table.

    Files are ordered by (part, before_in_part), documents in them by doc_id, nulls first; documents of one doc_id by
    text. A null text is empty. Columns: part, before_in_part, n_ids, uri, start (ids before the file).
    """
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "token-files")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal before, size
            ids = np.concatenate(held).astype(np.uint32)
            out = open_out(folder, ".rans")
            write_file(out, doc_ids, [len(h) for h in held], ids)
            out.close()
            row = (part, before, len(ids), out.uri)
            before += len(ids)
            doc_ids.clear()
            held.clear()
            size = 0
            return pa.RecordBatch.from_pylist([dict(zip(FILES.names, row))], schema=FILES)

        for doc, ids in encoder.documents(rows):
            doc_ids.append(doc)
            held.append(np.append(ids, ids.dtype.type(end_id)))
            size += len(ids) + 1
            if size >= MAX_IDS:
                yield flush()
        if doc_ids:
            yield flush()

    ordered = (docs.select("doc_id", text_of("text").alias("text"))
               .repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text"))
    files = materialize(ordered.mapInArrow(run, "part long, before_in_part long, n_ids long, uri string"), "token-files")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = prefix_total(parts, "part", "n", "part_start")
    return files.join(starts.drop("n"), "part").withColumn("start", F.col("part_start") + F.col("before_in_part")).drop("part_start")


def read(files: DataFrame) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, file; each file is decoded by one task."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def docs() -> Iterator[tuple]:
            for batch in rows:
                for uri, start in zip(*(c.to_pylist() for c in batch.columns)):
                    with open_in(uri) as f:
                        got = read_file(f)
                    ids = got.ids.astype("<u4")
                    ends = np.cumsum(got.lengths)
                    for doc, n, end in zip(got.doc_ids, got.lengths.tolist(), ends.tolist()):
                        yield doc, start + end - n, n, zlib.crc32(ids[end - n:end]), uri.rsplit("/", 1)[1]

        yield from batches(docs(), DOCS)

    spark = files.sparkSession
    return (files.select("uri", "start").repartition(partitions(spark), "uri")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string"))
