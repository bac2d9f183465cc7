"""Token counts without ids: each distinct pre-token is counted once and joined to the frequencies of documents.

Texts are read once, in blocks of about BLOCK_BYTES. A task inverts its block: a row per distinct pre-token with a number
in the block, and one row with the block's frequencies, which document holds which number how often, packed. The
pre-tokens of all blocks are brought together by equality; a sorted run of equal ones is counted once and every
block gets the count under its own number. Counts and frequencies meet again by block and are summed per document. What
is shuffled is a row per pre-token and block, never one per occurrence, and a group is one block at most.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import partitions, text_of

BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 65_000  # a document's place in its block takes two bytes
LIMIT = 2048
MAX_CHUNKS = 400_000
HELD = 2_000_000

INVERTED = pa.schema([("block", pa.int64()), ("no", pa.int32()), ("piece", pa.string()), ("doc_ids", pa.list_(pa.int64())),
                      ("n_bytes", pa.list_(pa.int64())), ("packed", pa.binary())])
INVERTED_DDL = "block long, no int, piece string, doc_ids array<long>, n_bytes array<long>, packed binary"
COUNTS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("packed", pa.binary()), ("counted", pa.binary())])
COUNTS_DDL = "block long, doc_ids array<long>, n_bytes array<long>, packed binary, counted binary"
COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
COUNTED_DDL = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: White space to Python's str methods, but not to the tokenizer.
ODD = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Pre-tokens of lower-case text that has no UNSURE character.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
UNSURE = re.compile("[\x1c-\x1f²³¹¼-¾İɐ-\U0010ffff]")

_kept: dict[str, "Pieces"] = {}


class Pieces:
    """Pre-tokens of chunks of text between white space, for one tokenizer file that drops white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.known: dict[str, tuple[str, ...]] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        """One per Python worker, kept from task to task."""
        if path not in _kept:
            _kept[path] = cls(path)
        return _kept[path]

    def of_chunk(self, chunk: str) -> tuple[str, ...]:
        found = self.known.get(chunk)
        if found is None:
            if len(self.known) > MAX_CHUNKS:
                self.known.clear()
            if "<" in chunk and self.added and self.added.search(chunk):
                parts = self.added.split(chunk)  # added tokens at odd places
                found = tuple(p for i, x in enumerate(parts) for p in ([x] if i % 2 else self._split(x)))
            else:
                found = tuple(self._split(chunk))
            self.known[chunk] = found
        return found

    def _split(self, chunk: str) -> list[str]:
        if not UNSURE.search(chunk):
            return PIECE.findall(chunk.lower())
        text = self.tok.normalizer.normalize_str(chunk) if self.tok.normalizer else chunk
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, pieces: list[str]) -> np.ndarray:
        return np.array([len(e.ids) for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)], np.int32)


def chunks_of(text: str) -> list[str]:
    return [c for c in SPACES.split(text) if c] if ODD.search(text) else text.split()


def _invert(block: int, doc_ids: list, texts: list[str], pieces: Pieces) -> Iterator[pa.RecordBatch]:
    chunk_no: dict[str, int] = {}
    docs, chunks, counts = [], [], []
    for i, t in enumerate(texts):
        c = Counter(chunks_of(t))
        docs.append(np.full(len(c), i, np.int64))
        chunks.append(np.fromiter((chunk_no.setdefault(k, len(chunk_no)) for k in c), np.int64, len(c)))
        counts.append(np.fromiter(c.values(), np.int64, len(c)))
    doc, chunk, n = (np.concatenate(x) for x in (docs, chunks, counts))
    piece_no: dict[str, int] = {}
    lists = [[piece_no.setdefault(p, len(piece_no)) for p in pieces.of_chunk(c)] for c in chunk_no]
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.array([p for x in lists for p in x], np.int64)
    starts = np.cumsum(sizes) - sizes
    # every (document, chunk) becomes one entry per piece of the chunk
    many = sizes[chunk]
    at = np.repeat(starts[chunk] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    key = flat[at] * len(texts) + np.repeat(doc, many)
    order = np.argsort(key, kind="stable")
    key, total = key[order], np.repeat(n, many)[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(total, first) if len(first) else total
    piece, doc = np.divmod(key[first], max(1, len(texts)))
    rows = len(piece_no)
    numbered = pa.RecordBatch.from_arrays([
        pa.array(np.full(rows, block)), pa.array(np.arange(rows, dtype=np.int32)), pa.array(list(piece_no), pa.string()),
        *(pa.nulls(rows, f.type) for f in list(INVERTED)[3:])], schema=INVERTED)
    for i in range(0, rows, 10_000):
        yield numbered.slice(i, 10_000)
    sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
    yield pa.RecordBatch.from_pylist([{"block": block, "doc_ids": doc_ids, "n_bytes": sizes, "packed": _pack(
        np.bincount(piece, minlength=rows), doc, total)}], schema=INVERTED)


def _pack(sizes: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> bytes:
    """Documents per pre-token number, then the documents and their counts in the order of numbers."""
    parts = [zlib.compress(x.astype(t).tobytes(), 1) for x, t in ((sizes, "<u4"), (docs, "<u2"), (counts, "<u4"))]
    return struct.pack("<QQ", len(parts[0]), len(parts[1])) + b"".join(parts)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = struct.unpack("<QQ", data[:16])
    parts = data[16:16 + a], data[16 + a:16 + a + b], data[16 + a + b:]
    return tuple(np.frombuffer(zlib.decompress(x), t).astype(np.int64) for x, t in zip(parts, ("<u4", "<u2", "<u4")))


def inverted(docs: DataFrame, tokenizer: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per block a row for each pre-token with its number, and one with its documents and frequencies."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, block = Pieces.of(tokenizer), TaskContext.get().partitionId() << 32
        doc_ids, texts, size = [], [], 0
        for batch in rows:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids.append(doc)
                texts.append(text)
                size += len(text) + 64
                if size >= block_bytes or len(texts) >= BLOCK_DOCS:
                    yield from _invert(block, doc_ids, texts, pieces)
                    block, doc_ids, texts, size = block + 1, [], [], 0
        if texts:
            yield from _invert(block, doc_ids, texts, pieces)

    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, INVERTED_DDL)


def piece_counts(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(block, counted) with the numbers of a block and their tokens, packed; rows without a piece pass as they are.

    Pre-tokens are met in order, so a run of equal ones is counted once. What a task has counted is sent on per block
    after every HELD entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, its = Pieces.of(tokenizer), None, 0
        blocks, numbers, counts, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            block, no, k = (np.concatenate(x) for x in (blocks, numbers, counts))
            order = np.argsort(block, kind="stable")
            block, no, k = block[order], no[order], k[order]
            first = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
            parts = [struct.pack("<I", len(x)) + zlib.compress(x.astype("<u4").tobytes() + y.astype("<u4").tobytes(), 1)
                     for x, y in zip(np.split(no, first[1:]), np.split(k, first[1:]))]
            ids = pa.array(block[first])
            yield pa.RecordBatch.from_arrays([ids, *(pa.nulls(len(ids), f.type) for f in list(COUNTS)[1:4]), pa.array(parts, pa.binary())], schema=COUNTS)

        for b in batches:
            whole = b.filter(pa.compute.is_null(b.column("piece")))
            if len(whole):
                yield pa.RecordBatch.from_arrays([*(whole.column(c) for c in ("block", "doc_ids", "n_bytes", "packed")), pa.nulls(len(whole), pa.binary())], schema=COUNTS)
            b = b.filter(pa.compute.is_valid(b.column("piece")))
            if not len(b):
                continue
            runs = pa.compute.run_end_encode(b.column("piece").cast(pa.string()))
            pieces = runs.values.to_pylist()
            new = pieces[1:] if pieces[0] == last else pieces
            k = np.concatenate([[its] if len(new) < len(pieces) else [], own.count(new) if new else []]).astype(np.int64)
            last, its = pieces[-1], int(k[-1])
            blocks.append(b.column("block").to_numpy())
            numbers.append(b.column("no").to_numpy())
            counts.append(np.repeat(k, np.diff(runs.run_ends.to_numpy(), prepend=0)))
            size += len(b)
            if size >= HELD:
                yield from flush()
                blocks, numbers, counts, size = [], [], [], 0
        if size:
            yield from flush()

    met = rows.repartition(partitions(rows.sparkSession), F.coalesce("piece", F.col("block").cast("string"))).sortWithinPartitions("piece")
    return met.mapInArrow(run, COUNTS_DDL)


def count(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of `docs` (doc_id, text).

    Counts are those of the library without added begin or end tokens; added tokens inside texts are its default. Null
    texts are empty: no bytes, no tokens. Repeated rows and null doc_ids are rows of their own. No rows: no rows. Other
    columns are ignored.
    """
    def total(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts, ids, sizes, packed = [], [], [], [], b""
        for b in group:
            for x in b.to_pylist():
                if x["counted"] is None:
                    ids, sizes, packed = x["doc_ids"], x["n_bytes"], x["packed"]
                    continue
                n = struct.unpack("<I", x["counted"][:4])[0]
                both = np.frombuffer(zlib.decompress(x["counted"][4:]), "<u4")
                numbers.append(both[:n])
                counts.append(both[n:])
        k = np.zeros(sum(map(len, numbers)), np.int64)
        for no, c in zip(numbers, counts):
            k[no] = c
        many, docs_, n = _unpack(packed)
        sums = np.bincount(docs_, np.repeat(k, many) * n, len(ids)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums), pa.array(sums > limit)], schema=COUNTED)

    return piece_counts(inverted(docs, tokenizer), tokenizer).groupBy("block").applyInArrow(total, COUNTED_DDL)
