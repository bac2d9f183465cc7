"""Byte-level BPE of whole texts by folding ranked merges with higher-order functions over distinct words.

A task cuts its documents into words (matches of the pattern) and numbers them as they are first met. What documents are made
of goes to a file as numbers, in blocks of about BLOCK_CHARS characters; the words go on as rows, dealt to GROUPS by their hash.
The words of a group from all files come together in one task, so every distinct word of the corpus goes once through Spark's
higher-order functions: an array of the ids of its bytes is folded by `aggregate`, one merge a step, the pair with the lowest
rank first and of equal ones the leftmost. Ranks come from a literal, an array of small maps from a pair of ids to the id that
replaces them; a pair's map is found by its hash. Behind the fold each file gets back the ids of its words, which are put into
the order of its documents, and decoding concatenates the binary pieces of the ids. Texts are not shuffled, and no task holds
more than the words of a file or of a group: a file ends after MAX_WORDS or MAX_FILE bytes, and forgets chunks of text after
MAX_CHUNKS. Rows name the files, so files of lost attempts are never read; the rows are stored, for a second attempt would
write others.

A fold copies the word at each step, which grows with the square of its length. Words of more than SHORT bytes are folded
by rank instead: a step merges all places of the lowest rank at once. Where a merge of that rank could make a pair of a
still lower rank beside it, only the leftmost place is merged, so ids are those of single merges.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import batches, fresh_dir, materialize, open_in, open_out, text_of

BLOCK_CHARS = 2 << 20
MAX_CHUNKS = 200_000
MAX_WORDS = 600_000
MAX_FILE = 32 << 20
#: Groups of words; a group is a byte in a file.
GROUPS = 256
#: Rows of words in a batch that goes to Spark.
ROWS = 100
SHORT = 256
BUCKETS = 32_768
#: Rank of a pair that is never merged.
NONE = (1 << 31) - 1

BLOCK = pa.schema([("doc_ids", pa.list_(pa.int64())), ("forget", pa.bool_()), ("lengths", pa.binary()), ("chunks", pa.binary()), ("chunk_sizes", pa.binary()),
                   ("chunk_pieces", pa.binary()), ("piece_refs", pa.binary()), ("groups", pa.binary())])
WORDS = pa.schema([("file", pa.string()), ("word_group", pa.int32()), ("raw", pa.binary()), ("sizes", pa.binary())])
WORDS_DDL = "file string, word_group int, raw binary, sizes binary"
NUMBERED = pa.schema([("file", pa.string()), ("word_group", pa.int32()), ("forget", pa.bool_()), ("refs", pa.binary()), ("words", pa.list_(pa.list_(pa.int32())))])
NUMBERED_DDL = "file string, word_group int, forget boolean, refs binary, words array<array<int>>"
FOLDED = pa.schema([("file", pa.string()), ("word_group", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary())])
FOLDED_DDL = "file string, word_group int, ids binary, sizes binary"
IDS_DDL = "doc_id long, n_tokens long, ids binary"

#: A space between two characters that are not white space: a match never goes on across it.
CUT = re.compile(r"(?<=\S) (?=\S)")

_kept: dict[str, "Vocabulary"] = {}


@dataclass(frozen=True)
class Vocabulary:
    """Ids of byte strings; the id of a string is also its rank."""

    ranks: dict[bytes, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """A rank file: per line a string in base 64 and its rank. All single bytes must have one. Kept per process."""
        if path not in _kept:
            with open_in(path) as f:
                lines = [line.split() for line in f.read().splitlines() if line.strip()]
            ranks = {base64.b64decode(a): int(b) for a, b in lines}
            if any(bytes([b]) not in ranks for b in range(256)):
                raise ValueError("every single byte needs a rank")
            _kept[path] = cls(ranks)
        return _kept[path]

    def pairs(self) -> dict[tuple[int, int], int]:
        """What two ids are merged to, for every pair that makes a known string."""
        return {(self.ranks[t[:i]], self.ranks[t[i:]]): r for t, r in self.ranks.items() for i in range(1, len(t))
                if t[:i] in self.ranks and t[i:] in self.ranks}

    def bytes_of_ids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All strings in the order of ids in a row, their starts and their sizes."""
        size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for t, r in self.ranks.items():
            size[r] = len(t)
        by_id = {r: t for t, r in self.ranks.items()}
        return np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(size))), np.uint8), np.cumsum(size) - size, size

    @property
    def base(self) -> int:
        return max(self.ranks.values()) + 1


def _bucket(left, right):
    return (left * 127 + right) % BUCKETS


def rank_map(pairs: dict[tuple[int, int], int], base: int) -> Column:
    """The literal: BUCKETS maps from left id * base + right id to the id of both."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for (a, b), r in pairs.items():
        buckets[_bucket(a, b)][str(a * base + b)] = r
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>").cast("array<map<bigint,int>>")


def lowering(pairs: dict[tuple[int, int], int]) -> list[int]:
    """Ids whose making can put a pair of a lower rank than their own beside them."""
    return sorted({x for (a, b), r in pairs.items() for x in (a, b) if r < x})


def fold(words: Column, vocabulary: Vocabulary) -> Column:
    """Ids of every word of an array of words, each given as the ids of its bytes."""
    pairs, base = vocabulary.pairs(), vocabulary.base

    def folded(table: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            found = F.try_element_at(F.get(table, _bucket(a, b)), a.cast("bigint") * base + b)
            return F.coalesce(found, F.lit(NONE))

        def ranks_of(w: Column) -> Column:
            return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), rank)

        def one_merge(s: Column) -> Column:
            parts, ranks = s["parts"], s["ranks"]

            def at(i: Column) -> Column:
                made, last = F.get(ranks, i), F.size(ranks) - 1
                beside = F.filter(F.array(F.when(i > 0, rank(F.get(parts, i - 1), made)),
                                          F.when(i < last, rank(made, F.get(parts, i + 2)))), lambda r: r.isNotNull())
                merged = F.struct(
                    F.concat(F.slice(parts, 1, i), F.array(made), F.slice(parts, i + 3, F.size(parts))).alias("parts"),
                    F.concat(F.slice(ranks, 1, F.greatest(i - 1, F.lit(0))), beside, F.slice(ranks, i + 3, F.size(parts))).alias("ranks"))
                return F.when(made == NONE, s).otherwise(merged)

            return let((F.array_position(ranks, F.array_min(ranks)) - 1).cast("int"), at)

        def short(w: Column) -> Column:
            start = F.struct(w.alias("parts"), ranks_of(w).alias("ranks"))
            return F.aggregate(F.sequence(F.lit(2), F.size(w)), start, lambda s, _: one_merge(s))["parts"]

        low = set(lowering(pairs))
        alone = F.split(F.lit(",".join("1" if x in low else "0" for x in range(base))), ",").cast("array<int>")

        def one_rank(s: Column) -> Column:
            parts = s["parts"]

            def at(ranks: Column) -> Column:
                low = F.array_min(ranks)

                def merge(m: Column) -> Column:
                    only = F.when(F.get(alone, m) == 1, F.array_position(ranks, m) - 1)
                    here = let(F.struct(only.alias("at")), lambda o: F.transform(
                        ranks, lambda r, i: F.when((r == m) & F.coalesce(o["at"] == i, F.lit(True)), "1").otherwise("0")))
                    # of places in a row every second one is merged, from the left
                    marks = F.concat(F.replace(F.array_join(here, ""), F.lit("11"), F.lit("10")), F.lit("0"))
                    kept = let(F.split(marks, ""), lambda mark: F.transform(parts, lambda p, i: F.when(
                        F.get(mark, i) == "1", m).when((i == 0) | (F.get(mark, i - 1) == "0"), p)))
                    return F.struct(F.filter(kept, lambda p: p.isNotNull()).alias("parts"), F.lit(False).alias("done"))

                over = F.struct(parts.alias("parts"), F.lit(True).alias("done"))
                return F.when(F.coalesce(low, F.lit(NONE)) == NONE, over).otherwise(let(low, merge))

            return F.when(s["done"], s).otherwise(let(ranks_of(parts), at))

        def long(w: Column) -> Column:
            start = F.struct(w.alias("parts"), F.lit(False).alias("done"))
            return F.aggregate(F.sequence(F.lit(2), F.size(w)), start, lambda s, _: one_rank(s))["parts"]

        return F.transform(words, lambda w: F.when(F.size(w) < 2, w).when(F.size(w) <= SHORT, short(w)).otherwise(long(w)))

    return let(rank_map(pairs, base), folded)


def let(value: Column, body) -> Column:
    """`body(value)`, with `value` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unlike_library() -> str:
    """Characters that `regex` takes for letters or numbers and tiktoken, by its older tables, does not: all are newer than
    Python's own tables, so only those are asked for."""
    import regex
    import tiktoken

    new = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    single = {bytes([b]): b for b in range(256)}
    known = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks=single, special_tokens={})
    return "".join(c for c in regex.findall(r"[\p{L}\p{N}]", new) if not known.encode_ordinary(c))


class _Cutter:
    """Cuts texts to chunks and chunks to words for one file, and numbers what is new.

    `other` are characters that are neither letters nor numbers nor white space, whatever `regex` says.
    """

    def __init__(self, pattern: str, other: str, ranks: dict[bytes, int], folder: str):
        import regex

        self.match = regex.compile(pattern)
        self.other, self.masked = set(other), {ord(c): "\uffff" for c in other}
        self.ranks = ranks
        self.heads: dict[str, int] = {}  # first chunks of texts
        self.rest: dict[str, int] = {}  # others, without the space before them
        self.odd: set[int] = set()
        self.words: dict[str, int] = {}
        self.folded = 0  # words that are to be folded
        self.groups: list[np.ndarray] = []
        self.out = open_out(folder, ".arrows")

    def full(self) -> bool:
        return len(self.words) > MAX_WORDS or self.out.size > MAX_FILE

    def _number(self, kept: dict[str, int], chunks: list[str], new: list[str]) -> list[int]:
        get, out = kept.get, []
        for c in chunks:
            k = get(c)
            if k is None:
                k = kept[c] = len(self.heads) + len(self.rest)
                new.append(c if kept is self.heads else " " + c)
                if not c or c[0].isspace() or c[-1].isspace():
                    self.odd.add(k)
            out.append(k)
        return out

    def _split(self, c: str) -> list[str]:
        if c.isascii() or self.other.isdisjoint(c):
            return self.match.findall(c)
        return [c[m.start():m.end()] for m in self.match.finditer(c.translate(self.masked))]

    def block(self, doc_ids: list, texts: list[str]) -> None:
        forget = len(self.heads) + len(self.rest) > MAX_CHUNKS
        if forget:
            self.heads, self.rest, self.odd = {}, {}, set()
        new: list[str] = []
        lengths, chunks = [], []
        for t in texts:
            first, *others = t.split(" ")
            found = self._number(self.heads, [first], new) + self._number(self.rest, others, new)
            if len(found) > 1 and self.odd and not self.odd.isdisjoint(found):
                first, *others = CUT.split(t)  # other white space around a space
                found = self._number(self.heads, [first], new) + self._number(self.rest, others, new)
            lengths.append(len(found))
            chunks.extend(found)
        before, number = len(self.words), self.words.setdefault
        pieces = [[number(w, len(self.words)) for w in self._split(c)] for c in new]
        raw = [w.encode("utf-8", "surrogatepass") for w in islice(reversed(self.words), len(self.words) - before)][::-1]
        refs = np.fromiter((self.ranks.get(w, -1) for w in raw), np.int32, len(raw))  # a known word is its id, without merges
        fresh = [w for w, r in zip(raw, refs.tolist()) if r < 0]
        refs[refs < 0] = -1 - self.folded - np.arange(len(fresh), dtype=np.int32)
        groups = np.fromiter((zlib.crc32(w) % GROUPS for w in fresh), np.uint8, len(fresh))
        self.folded += len(fresh)
        self.groups.append(groups)
        flat = [p for x in pieces for p in x]
        packed = [np.array(lengths, np.int32), np.array(chunks, np.int32), np.array([len(x) for x in pieces], np.int32),
                  np.array(flat, np.int32), refs]
        row = pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), pa.array(doc_ids, pa.int64())),
            pa.array([forget]), *(pa.array([_packed(x)], pa.binary()) for x in packed), pa.array([groups.tobytes()], pa.binary())], schema=BLOCK)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, BLOCK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(row)
        self.out.write(sink.getvalue())

    def close(self) -> Iterator[tuple]:
        """Ends the file. Rows of WORDS, one at least: the words of a group in the order of their numbers."""
        self.out.close()
        raw = (w.encode("utf-8", "surrogatepass") for w in self.words)
        fresh = [w for w in raw if w not in self.ranks]
        self.heads, self.rest, self.words = {}, {}, {}
        groups = np.concatenate(self.groups)
        order = np.argsort(groups, kind="stable")
        words = [fresh[i] for i in order.tolist()]
        ends = np.cumsum(np.bincount(groups, minlength=GROUPS)).tolist()
        for group, (a, b) in enumerate(zip([0, *ends], ends)):
            if a < b or not words and not group:
                yield self.out.uri, group, b"".join(words[a:b]), _packed(np.array(list(map(len, words[a:b])), np.int32))


def _packed(numbers: np.ndarray) -> bytes:
    """The lowest bytes of 32-bit numbers, then the next ones, and so on, which compresses better."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(packed: bytes, dtype: str = "<i4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view(dtype).ravel()


def _blocks(file: str, columns: list[str]) -> Iterator[dict]:
    """The blocks of a file, one at a time."""
    with open_in(file) as f:
        end = f.size()
        while f.tell() < end:
            with pa.ipc.open_stream(f) as stream:
                yield from stream.read_all().select(columns).to_pylist()


class _Lists:
    """Lists of ids, with more added at the end."""

    def __init__(self):
        self.many, self.used = 0, 0
        self.values, self.starts, self.sizes = np.empty(1024, "<u4"), np.empty(256, np.int64), np.empty(256, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        many, used = self.many + len(sizes), self.used + len(values)
        if used > len(self.values):
            self.values = np.concatenate([self.values[:self.used], np.empty(2 * used - self.used, "<u4")])
        if many > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x[:self.many], np.empty(2 * many - self.many, np.int64)]) for x in (self.starts, self.sizes))
        self.values[self.used:used] = values
        self.sizes[self.many:many] = sizes
        self.starts[self.many:many] = self.used + np.cumsum(sizes) - sizes
        self.many, self.used = many, used

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists `which` in a row, and their sizes."""
        many = self.sizes[which]
        return self.values[np.repeat(self.starts[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())], many


class _Uniter:
    """Keeps the ids of words and chunks as `_Cutter` numbers them, and makes the ids of documents of a file.

    `values` and `sizes` are the ids of the words in the order of `groups`, which holds the group of each word.
    """

    def __init__(self, values: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        self.words, self.refs, self.chunks = _Lists(), np.empty(0, np.int64), _Lists()
        self.words.add(values, sizes)
        self.place = np.empty(len(groups), np.int64)
        self.place[np.argsort(groups, kind="stable")] = np.arange(len(groups))

    def documents(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the documents of a block in a row, and how many each has."""
        if row["forget"]:
            self.chunks = _Lists()
        lengths, chunks, chunk_sizes, pieces, refs = (_numbers(row[c]) for c in BLOCK.names[2:7])
        # words that are known stand for themselves and are lists as well
        known, at = refs >= 0, self.words.many
        self.words.add(refs[known], np.ones(known.sum(), np.int64))
        where = np.empty(len(refs), np.int64)
        where[known] = at + np.arange(known.sum())
        where[~known] = self.place[-1 - refs[~known]]
        self.refs = np.concatenate([self.refs, where])
        values, sizes = self.words.take(self.refs[pieces])
        self.chunks.add(values, _summed(sizes, chunk_sizes))
        values, sizes = self.chunks.take(chunks)
        return values, _summed(sizes, lengths)


def _summed(sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Sums of so many of `sizes` in a row as `groups` says."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.diff(ends[np.concatenate([[0], np.cumsum(groups.astype(np.int64))])])


def cut_words(docs: DataFrame, rank_file: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Writes files of numbered texts of `docs` (doc_id, text). Rows of WORDS, stored: the words of a file that are to be folded."""
    other, folder = unlike_library(), fresh_dir(docs.sparkSession, "byte_bpe")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None
        doc_ids, texts, size = [], [], 0
        for batch in rows:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc)
                texts.append(text)
                size += len(text) + 64
                if size >= block_chars:
                    cutter = cutter or _Cutter(pattern, other, Vocabulary.read(rank_file).ranks, folder)
                    cutter.block(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
                    if cutter.full():
                        yield from batches(cutter.close(), WORDS, ROWS)
                        cutter = None
                        pa.default_memory_pool().release_unused()
        if texts:
            cutter = cutter or _Cutter(pattern, other, Vocabulary.read(rank_file).ranks, folder)
            cutter.block(doc_ids, texts)
        if cutter:
            yield from batches(cutter.close(), WORDS, ROWS)
            pa.default_memory_pool().release_unused()

    return materialize(docs.select("doc_id", text_of("text").alias("text")).mapInArrow(cut, WORDS_DDL), "byte_bpe")


def _small(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, ROWS) for b in rows for k in range(0, b.num_rows, ROWS))


def distinct_words(cuts: DataFrame, rank_file: str) -> DataFrame:
    """Rows of NUMBERED: the numbers of the words of a file in their group, and those words of the group that no row before had,
    each as the ids of its bytes. A group starts with the row that says to forget the one before."""

    ranks = Vocabulary.read(rank_file).ranks
    of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def number(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known = None, {}
        for batch in _small(rows):
            found, new, per_row = [], [], []
            for file, g, raw, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                forget = g != group
                if forget:
                    group, known = g, {}
                before, put = len(known), known.setdefault
                ends = np.cumsum(_numbers(sizes)).tolist()
                refs = [put(raw[a:b], len(known)) for a, b in zip([0, *ends], ends)]
                new += list(islice(reversed(known), len(known) - before))[::-1]
                per_row.append(len(known) - before)
                found.append((file, g, forget, np.array(refs, np.int32).tobytes()))
            words = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, new)]).astype(np.int32)),
                                             pa.array(of_byte[np.frombuffer(b"".join(new), np.uint8)]))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *per_row]).astype(np.int32)), words)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found), NUMBERED)]
            yield pa.RecordBatch.from_arrays([*columns, lists], schema=NUMBERED)

    return cuts.repartition("word_group").sortWithinPartitions("word_group").mapInArrow(number, NUMBERED_DDL)


def _gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FOLDED from rows of NUMBERED with folded words: the ids of the words of a file and group."""
    kept = _Lists()
    for b in _small(rows):
        found, words = [], b.column("words")
        for i, (file, group, forget, refs) in enumerate(zip(*(b.column(c).to_pylist() for c in NUMBERED.names[:4]))):
            if forget:
                kept = _Lists()
            new = words.slice(i, 1).flatten()
            offsets = new.offsets.to_numpy().astype(np.int64)
            kept.add(new.values.to_numpy()[offsets[0]:offsets[-1]], np.diff(offsets))
            values, sizes = kept.take(np.frombuffer(refs, np.int32))
            found.append((file, group, _packed(values), _packed(sizes.astype(np.int32))))
        yield from batches(iter(found), FOLDED)


def encode(docs: DataFrame, rank_file: str, pattern: str, *, decoded: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) of every row of `docs` (doc_id, text).

    Each match of `pattern` is encoded by itself: as it stands if it is known, else by merges. `pattern` must not match across
    a single space between two characters that are not white space. `decoded` adds a column with the bytes of the ids, as
    `decode` gives them, in the same pass.
    Null and empty texts have no ids. Repeated rows and null doc_ids are rows of their own. No rows: no rows. Other columns
    are ignored.
    """
    ddl = IDS_DDL + (", decoded binary" if decoded else "")

    def unite(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Vocabulary.read(rank_file).bytes_of_ids() if decoded else None
        each = (r for b in _small(rows) for r in zip(*(c.to_pylist() for c in b.columns)))
        for file, parts in groupby(each, key=lambda r: r[0]):
            values, sizes = zip(*((_numbers(v, "<u4"), _numbers(n)) for _, _, v, n in parts))
            groups = b"".join(x["groups"] for x in _blocks(file, ["groups"]))
            uniter = _Uniter(np.concatenate(values), np.concatenate(sizes).astype(np.int64), np.frombuffer(groups, np.uint8))
            for row in _blocks(file, BLOCK.names[:7]):
                values, sizes = uniter.documents(row)
                ids = np.split(values, np.cumsum(sizes)[:-1])
                for k in range(0, len(ids), 500):
                    part = [x.tobytes() for x in ids[k:k + 500]]
                    columns = [pa.array(row["doc_ids"][k:k + 500], pa.int64()), pa.array(sizes[k:k + 500]), pa.array(part, pa.binary())]
                    if decoded:
                        columns.append(pa.array([_bytes_of(x, pieces) for x in part], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][:len(columns)])
            pa.default_memory_pool().release_unused()

    words = distinct_words(cut_words(docs, rank_file, pattern, block_chars), rank_file)
    folded = words.withColumn("words", fold(F.col("words"), Vocabulary.read(rank_file))).mapInArrow(_gather, FOLDED_DDL)
    return folded.repartition("file").sortWithinPartitions("file", "word_group").mapInArrow(unite, ddl)


def _bytes_of(ids: bytes, pieces: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """The binary pieces of ids, concatenated."""
    raw, starts, sizes = pieces
    x = np.frombuffer(ids, "<u4")
    if len(x) and (int(x.max()) >= len(sizes) or not sizes[x].all()):
        raise ValueError("an id that the vocabulary has not")
    many = sizes[x]
    return raw[np.repeat(starts[x] - (np.cumsum(many) - many), many) + np.arange(many.sum())].tobytes()


def decode(encoded: DataFrame, rank_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its `ids` (binary, little-endian unsigned 32-bit) as a further column `out`.

    Null ids: null. Ids that the vocabulary has not are an error.
    """
    schema = encoded.drop(out).withColumn(out, F.lit(None).cast("binary")).schema
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Vocabulary.read(rank_file).bytes_of_ids()
        for b in batches:
            found = [None if x is None else _bytes_of(x, pieces) for x in b.column(at).to_pylist()]
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns) if n != out]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(found, pa.binary())], names=[*(n for n, _ in kept), out])

    return encoded.mapInArrow(run, schema)
