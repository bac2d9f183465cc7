"""Benchmark decontamination: rare word n-grams of test items as seeds, Smith-Waterman alignment as the judge.

Words are lower-case runs of letters and digits. Documents are read once: a task looks up every n-gram in the grams of
the test items and returns the words around its finds. From these the number of documents per gram is known, over all
documents. Seeds are grams that are rare beside their neighbours: of every few grams in a row the rarest is one, however
many documents share it, so each stretch of an item has seeds. Stretches with seeds are aligned with their item word by
word, so edited and paraphrased copies score by what is left of the item; a long run of a long item counts too, by its own
score. An item of few words says nothing inside other text: it has to be a whole line of the document, word for word.

Test items are a query set held against all documents in blocks of BLOCK_WORDS words at most; a block is what tasks
get in memory, and a longer set means more passes, not more memory.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import batches, materialize, text_of

WORD = re.compile(r"[^\W_]+")
BLOCK_WORDS = 200_000
MATCH, MISMATCH, GAP = 2, -1, -1
MIX = np.uint64(0x9E3779B97F4A7C15)


class Settings(NamedTuple):
    """n: words of a gram. A gram is a seed if some `window` grams in a row of the item, it among them, have none that is in
    fewer than 1 / times as many documents; each item keeps its min_seeds rarest grams in any case. min_score: share of
    the best score an item can have; min_run: an alignment also counts if it scores as much as this many equal words in a
    row. Items of fewer words than whole_line have to be a line of their own."""

    n: int = 4
    window: int = 4
    times: int = 100
    min_seeds: int = 16
    slack: int = 16
    min_score: float = 0.5
    min_run: int = 40
    whole_line: int = 8


NEAR = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("words", pa.list_(pa.int32())),
                  ("at", pa.list_(pa.int32())), ("grams", pa.list_(pa.int64())), ("lines", pa.list_(pa.int32()))])
LINKS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("n_seeds", pa.int64()),
                   ("first_word", pa.int64()), ("last_word", pa.int64())])
LINKS_DDL = "doc_id long, text_hash long, item_id long, score double, n_seeds long, first_word long, last_word long"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _hash_of(text: str) -> int:
    """What Spark's xxhash64 says of the text."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def grams_of(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each n words in a row; short sequences are one gram."""
    n = min(n, len(ids))
    out = np.zeros(len(ids) - n + 1 if n else 0, np.uint64)
    for i in range(n):
        out = (out ^ ids[i:len(ids) - n + 1 + i].astype(np.uint64)) * MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def lines_of(text: str) -> np.ndarray:
    """Numbers of the words that start a line, and the number of words at the end."""
    sizes = [len(WORD.findall(x)) for x in text.lower().split("\n")]
    return np.unique(np.cumsum([0, *sizes]))


class Items:
    """A block of test items: word numbers, and which grams occur in which items."""

    def __init__(self, rows: list[tuple[int | None, str]], n: int):
        self.vocabulary: dict[str, int] = {}
        self.words: dict[int, np.ndarray] = {}
        self.ids: list[int | None] = []
        self.items_of: dict[int, list[int]] = defaultdict(list)
        self.grams: list[np.ndarray] = []  # in the order of the item
        self.shortest = n
        for item, text in rows:
            w = words_of(text)
            if not w:
                continue
            i = len(self.ids)
            self.ids.append(item)
            self.words[i] = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64)
            self.grams.append(grams_of(self.words[i], n))
            self.shortest = min(self.shortest, len(w))
            for g in np.unique(self.grams[-1]).tolist():
                self.items_of[g].append(i)
        self.longest = max((len(w) for w in self.words.values()), default=0)
        self.sorted = np.unique(np.fromiter(self.items_of, np.int64, len(self.items_of)))

    def finds(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and grams of a document that some item has, grams of short items among them."""
        at, grams = [], []
        for k in range(self.shortest, n + 1):
            if len(ids) < k or not len(self.sorted):
                continue
            g = grams_of(ids, k)
            i = np.searchsorted(self.sorted, g)
            hit = np.flatnonzero(self.sorted[np.minimum(i, len(self.sorted) - 1)] == g)
            at.append(hit)
            grams.append(g[hit])
        return (np.concatenate(at), np.concatenate(grams)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment score (linear gaps) and the position in `words` where it ends."""
    steps = GAP * np.arange(len(words) + 1)
    above, best, end = np.zeros(len(words) + 1, np.int64), 0, 0
    for w in item:
        row = np.zeros_like(above)
        row[1:] = np.maximum(0, np.maximum(above[:-1] + np.where(words == w, MATCH, MISMATCH), above[1:] + GAP))
        row = np.maximum.accumulate(row - steps) + steps
        above = row
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), j
    return best, end


def score(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int]:
    """Share of the item's best score, first and last position in `words` of the alignment."""
    best, end = align(item, words)
    _, back = align(item[::-1], words[:end][::-1])
    return best / (MATCH * len(item)), end - back, end - 1


def line_with(item: np.ndarray, words: np.ndarray, lines: list[int]) -> int | None:
    """Where the first line starts that is the item, by the starts of lines and the end of the text."""
    for a, b in zip(lines, lines[1:]):
        if b - a == len(item) and (words[a:b] == item).all():
            return a
    return None


def _blocks(items: DataFrame) -> int:
    total = items.agg(F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0)).alias("n")).first().n
    return max(1, -(-total // (BLOCK_WORDS // 2)))


def _near(docs: DataFrame, items: Items, settings: Settings) -> DataFrame:
    """Words around the finds of each document, as numbers of the items' vocabulary (0: none of it)."""
    reach = items.longest + settings.slack
    short = any(len(w) < settings.whole_line for w in items.words.values())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            number = items.vocabulary.get
            for batch in rows:
                for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                    ids = np.array([number(w, 0) for w in words_of(text)], np.int64)
                    at, grams = items.finds(ids, settings.n)
                    if not len(at):
                        continue
                    order = np.argsort(at, kind="stable")
                    at, grams = at[order], grams[order]
                    key = _hash_of(text)
                    lines = lines_of(text) if short else np.zeros(0, np.int64)
                    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * reach) + 1):
                        low, high = max(0, at[part[0]] - reach), at[part[-1]] + settings.n + reach
                        near = lines[(lines >= low) & (lines <= high)] - low
                        yield doc, key, int(low), ids[low:high].tolist(), (at[part] - low).tolist(), grams[part].tolist(), near.tolist()

        yield from batches(each(), NEAR, 500)

    return materialize(docs.select("doc_id", text_of("text").alias("text")).mapInArrow(
        run, "doc_id long, text_hash long, first int, words array<int>, at array<int>, grams array<long>, lines array<int>"), "finds")


def _seeds(near: DataFrame, items: Items, settings: Settings) -> dict[int, list[int]]:
    """Seeds and the items they stand for; at most as many rows as the items have grams come to the driver."""
    per = near.select("doc_id", "text_hash", F.explode("grams").alias("gram")).distinct().groupBy("gram").agg(F.count("*").alias("n")).collect()
    docs = Counter({r.gram: r.n for r in per})
    seeds: dict[int, list[int]] = defaultdict(list)
    for i, grams in enumerate(items.grams):
        for g in _seeds_of(grams, np.array([docs[g] for g in grams.tolist()], np.int64), settings):
            seeds[g].append(i)
    return dict(seeds)


def _seeds_of(grams: np.ndarray, docs: np.ndarray, settings: Settings) -> set[int]:
    """Seeds among the grams of an item in order, which lie in `docs` documents each."""
    w = min(settings.window, len(grams))
    least = np.maximum(1, np.lib.stride_tricks.sliding_window_view(docs, w).min(1))  # of each window
    bound = np.array([least[max(0, p - w + 1):p + 1].max() for p in range(len(grams))])  # of the best window with a gram
    rarest = sorted(set(zip(docs.tolist(), grams.tolist())))[:settings.min_seeds]
    return set(grams[docs <= settings.times * bound].tolist()) | {g for _, g in rarest}


def contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Links of documents (doc_id, text) and test items (item_id, text) that reach `min_score` or `min_run`, the best of
    each pair; items of few words link with documents that have them as a line, with score 1.

    Columns: doc_id, text_hash (of the document's text), item_id, score, n_seeds, first_word and last_word of the
    alignment. Null or wordless texts of either table have no links; repeated rows have links of their own, null ids
    stay. Items shorter than a gram are one gram. No rows in either table: no rows. Other columns are ignored.
    """
    items = items.select("item_id", text_of("text").alias("text"))
    blocks, out = _blocks(items), None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        block = Items([tuple(r) for r in part.collect()], settings.n)  # BLOCK_WORDS bounds it
        near = _near(docs, block, settings)
        links = _aligned(near, block, _seeds(near, block, settings), settings)
        out = links if out is None else out.unionByName(links)
    return materialize(out, "contaminated") if blocks > 1 else out


def _aligned(near: DataFrame, items: Items, seeds: dict[int, list[int]], settings: Settings) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in rows:
                for doc, key, first, words, at, grams, lines in zip(*(c.to_pylist() for c in batch.columns)):
                    hits: dict[int, list[int]] = defaultdict(list)
                    for p, g in zip(at, grams):
                        for i in seeds.get(g, ()):
                            hits[i].append(p)
                    words = np.array(words, np.int64)
                    for i, places in hits.items():
                        item = items.words[i]
                        if len(item) < settings.whole_line:
                            a = line_with(item, words, lines)
                            if a is not None:
                                yield doc, key, items.ids[i], 1.0, len(places), a + first, a + first + len(item) - 1
                            continue
                        reach = len(item) + settings.slack
                        places = np.array(sorted(places))
                        best = (0.0, 0, 0)
                        for part in np.split(places, np.flatnonzero(np.diff(places) > 2 * reach) + 1):
                            low, high = max(0, part[0] - reach), part[-1] + settings.n + reach
                            s, a, z = score(item, words[low:high])
                            best = max(best, (s, int(a + low) + first, int(z + low) + first), key=lambda x: x[0])
                        if best[0] >= min(settings.min_score, settings.min_run / len(item)):
                            yield doc, key, items.ids[i], best[0], len(places), best[1], best[2]

        yield from batches(each(), LINKS)

    found = near.mapInArrow(run, LINKS_DDL)
    return found.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max("score").alias("score"), F.sum("n_seeds").alias("n_seeds"), F.max_by("first_word", "score").alias("first_word"),
        F.max_by("last_word", "score").alias("last_word"))


def clean(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`docs` without the documents that have a link."""
    bad = materialize(contaminated(docs, items, settings).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "leaks")
    marked = docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return marked.join(bad, marked["doc_id"].eqNullSafe(bad["_id"]) & (marked["_key"] == bad["_hash"]), "left_anti").drop("_key")
