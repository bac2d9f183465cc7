"""Secrets in texts: fixed patterns, and long tokens that look more like random strings than like ordinary identifiers.

Two first-order character models are compared by the logarithm of their likelihood ratio per character. Both are
trained on labelled strings: random ones are the values that the fixed patterns find, plus strings drawn uniformly from
the alphabets of common keys; ordinary ones are all words and identifiers of all texts that are neither such values
nor candidates themselves. The
corpus is read once: tasks return spans, candidate tokens and their transition counts, and what is scored afterwards are
the few candidates.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.llm.common import batches, materialize, text_of

#: The patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
WORDS_BEFORE = (b"passw", b"secret", b"token", b"api")

KINDS = ("assign", "access", "hex", "markov")
TOKEN_CHARS = string.ascii_letters + string.digits + "+/_=-"
TOKEN_BYTES = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_BYTES)
SIDE = len(TOKEN_CHARS) + 1
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Number of a character; 0 for all that no token holds.
NUMBER = np.zeros(256, np.uint16)
NUMBER[np.frombuffer(TOKEN_CHARS.encode(), np.uint8)] = np.arange(1, SIDE)
IN_TOKEN = bytes(49 if NUMBER[b] else 48 for b in range(256))
IN_HEX = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))

SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
NEAR = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("token", pa.string())]))
SCANNED = pa.schema([("doc_id", pa.int64()), ("base", SPAN), ("near", NEAR), ("random", pa.list_(pa.int64())), ("ordinary", pa.list_(pa.int64()))])
SCANNED_DDL = ("doc_id long, base array<struct<kind string, start long, end long>>, "
               "near array<struct<start long, end long, token string>>, random array<long>, ordinary array<long>")
FOUND = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                   ("base_sha256", pa.string()), ("n_markov", pa.int64()), ("spans", pa.string())])


class Settings(NamedTuple):
    """min_score: natural logarithm of the likelihood ratio, per character; drawn: random strings of each alphabet."""

    min_score: float = 0.5
    drawn: int = 500
    seed: int = 7


class Model(NamedTuple):
    """Logarithm of the likelihood ratio of each transition."""

    ratio: np.ndarray

    def score(self, token: str) -> float:
        n = NUMBER[np.frombuffer(token.encode("ascii"), np.uint8)].astype(np.int64)
        return float(self.ratio[n[:-1] * SIDE + n[1:]].sum() / max(1, len(n) - 1))


def transitions(data: bytes) -> np.ndarray:
    """Counts of adjacent characters of tokens."""
    n = NUMBER[np.frombuffer(data, np.uint8)]
    both = (n[:-1] > 0) & (n[1:] > 0)
    return np.bincount(n[:-1][both].astype(np.int64) * SIDE + n[1:][both], minlength=SIDE * SIDE)


def drawn_strings(settings: Settings) -> list[str]:
    rng = np.random.default_rng(settings.seed)
    alphabets = [string.hexdigits[:16], string.ascii_letters + string.digits, TOKEN_CHARS, string.ascii_uppercase + string.digits]
    return ["".join(rng.choice(list(a), 40)) for a in alphabets for _ in range(settings.drawn)]


def train(random: np.ndarray, ordinary: np.ndarray, weight: float = 16.0) -> Model:
    """From transition counts of labelled strings. Shares of a character's successors are mixed with `weight` counts of
    the shares that characters have anywhere, where each counts one more than seen."""
    def log_share(counts: np.ndarray) -> np.ndarray:
        c = counts.reshape(SIDE, SIDE).astype(float)
        anywhere = c.sum(0) + 1
        return np.log((c + weight * anywhere / anywhere.sum()) / (c.sum(1, keepdims=True) + weight)).ravel()

    return Model(log_share(random) - log_share(ordinary))


def base_spans(text: str, data: bytes | None = None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself) by start, then kind; code points."""
    data = text.encode("utf-8", "surrogatepass") if data is None else data
    out = []
    low = data.translate(LOWER)
    if any(w in low for w in WORDS_BEFORE):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST_VALUE]
    if b"AKIA" in data:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"1" * LEAST_HEX in data.translate(IN_HEX):
        out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, data: bytes, base: list[tuple[str, int, int, int]]) -> list[tuple[int, int, str]]:
    """Long tokens, and the long parts outside base spans of those that such spans touch; one pass over both in order."""
    if b"1" * TOKEN_BYTES not in data.translate(IN_TOKEN):
        return []
    out, spans, k = [], sorted((s, e) for _, s, e, _ in base), 0
    for m in TOKEN.finditer(text):
        at, end = m.span()
        while k < len(spans) and spans[k][0] < end:
            s, e = spans[k]
            if s - at >= TOKEN_BYTES:
                out.append((at, s, text[at:s]))
            at = max(at, e)
            if e > end:  # may reach into the next token
                break
            k += 1
        if end - at >= TOKEN_BYTES:
            out.append((at, end, text[at:end]))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """A stored table with a row per document (base spans, candidates), and per task a row of transition counts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random, ordinary = np.zeros(SIDE * SIDE, np.int64), np.zeros(SIDE * SIDE, np.int64)

        def each() -> Iterator[tuple]:
            nonlocal random, ordinary
            for batch in rows:
                for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                    data = text.encode("utf-8", "surrogatepass")
                    base = base_spans(text, data)
                    near = candidates(text, data, base)
                    rest = data
                    if base or near:
                        secrets = " ".join(text[at:end] for _, _, end, at in base)
                        random += transitions(secrets.encode("utf-8", "surrogatepass"))
                        cut, at = [], 0
                        for start, end in sorted([(s, e) for _, s, e, _ in base] + [(s, e) for s, e, _ in near]):
                            cut.append(text[at:max(at, start)])
                            at = max(at, end)
                        rest = " ".join([*cut, text[at:]]).encode("utf-8", "surrogatepass")
                    ordinary += transitions(rest)
                    yield (doc, [{"kind": k, "start": s, "end": e} for k, s, e, _ in base],
                           [{"start": s, "end": e, "token": t} for s, e, t in near], None, None)
            yield None, None, None, random.tolist(), ordinary.tolist()

        yield from batches(each(), SCANNED, 2000)

    return materialize(docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, SCANNED_DDL), "secrets")


def fit(scanned: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of a scanned corpus: counts of all tasks, SIDE * SIDE numbers whatever the input, and drawn strings."""
    pairs = scanned.where("random is not null").select(F.posexplode(F.arrays_zip("random", "ordinary")))
    sums = pairs.groupBy("pos").agg(F.sum("col.random").alias("r"), F.sum("col.ordinary").alias("o")).collect()
    random, ordinary = np.zeros(SIDE * SIDE, np.int64), np.zeros(SIDE * SIDE, np.int64)
    for r in sums:
        random[r.pos], ordinary[r.pos] = r.r, r.o
    return train(random + transitions(" ".join(drawn_strings(settings)).encode()), ordinary)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def find(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Spans of every row of `docs` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, n_markov, spans.

    Spans are matches of the patterns and tokens that the models take for random. Null texts are empty; repeated rows
    are rows of their own; null doc_ids stay. No rows: no rows. Other columns are ignored.
    """
    scanned = scan(docs)
    model = fit(scanned, settings)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in rows:
                for doc, base, near in zip(*(c.to_pylist() for c in batch.columns)):
                    spans = [(s["kind"], s["start"], s["end"]) for s in base]
                    more = [("markov", c["start"], c["end"]) for c in near if model.score(c["token"]) >= settings.min_score]
                    n = [sum(s[0] == k for s in spans) for k in KINDS[:3]]
                    yield doc, *n, hashlib.sha256(joined(spans).encode()).hexdigest(), len(more), joined(spans + more)

        yield from batches(each(), FOUND)

    return scanned.where("base is not null").select("doc_id", "base", "near").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, n_markov long, spans string")


def redact(docs: DataFrame, settings: Settings = Settings(), mark: str = "[secret]") -> DataFrame:
    """`docs` with every span of `find` replaced by `mark`; overlapping spans are one. Null texts and other columns stay;
    a column n_chars follows the new text."""
    model = fit(scan(docs), settings)

    def without(text: str | None) -> str | None:
        if not text:
            return text
        data = text.encode("utf-8", "surrogatepass")
        base = base_spans(text, data)
        spans = [(s, e) for _, s, e, _ in base]
        spans += [(s, e) for s, e, t in candidates(text, data, base) if model.score(t) >= settings.min_score]
        out, at = [], 0
        for s, e in sorted(spans):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]]) if spans else text

    @F.pandas_udf(T.StringType())
    def redacted(texts: pd.Series) -> pd.Series:
        return pd.Series([without(t) for t in texts], dtype=object)

    out = docs.withColumn("text", redacted("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
