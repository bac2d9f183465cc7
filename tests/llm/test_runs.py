import hashlib
import re
import zlib

import numpy as np

from tests.llm.cases import PASSAGE, TEXTS, documents, plain, same
from tracklane.llm import queries, runs
from tracklane.llm.runs import Run


def brute(words):
    """Every stretch with its smallest period, by comparing all words at all lags."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((Run(s, k, q) for (s, k), q in best.items()), key=lambda r: (r.start, r.period))


def sequences():
    rng = np.random.default_rng(3)
    for _ in range(400):
        parts = []
        for _ in range(rng.integers(1, 6)):
            base = rng.integers(0, rng.integers(1, 6), rng.integers(1, 9)).tolist()
            whole = base * int(rng.integers(1, 9))
            parts += whole[: int(rng.integers(1, len(whole) + 1))]
        yield parts


def test_runs_equal_brute_force():
    all_ = list(sequences())
    want = [brute(x) for x in all_]
    assert any(len(x) > 2 for x in want)
    assert runs.runs_of([np.array(x, np.int64) for x in all_]) == want
    for x, w in zip(all_, want):  # without splitting, and one by one
        assert runs.scan_lags(np.array(x, np.int64)) == sorted(w)


def test_splitting_leaves_no_rare_word():
    words = np.array([1, 2] * 6 + [9] + [3, 4, 5] * 3 + [9] + [7] * 6)
    starts, ends = runs.segments(words, np.array([0]), np.array([len(words)]))
    assert [(s, e) for s, e in zip(starts.tolist(), ends.tolist())] == [(0, 12), (23, 29)]


def test_long_periodic_text_is_near_linear():
    one = np.zeros(400_000, np.int64)
    assert runs.scan_lags(one) == [Run(0, 400_000, 1)]
    base = np.random.default_rng(1).integers(0, 5000, 30_000)
    assert runs.runs_of([np.tile(base, 8)]) == [[Run(0, 240_000, 30_000)]]


def test_whole_table(spark):
    rows = TEXTS + [(20, "a b " * 9), (21, "x y z z " * 5 + "end"), (22, "go " * 6), (23, "go " * 5), (24, PASSAGE * 5)]

    def repeat(doc, n):
        return (1, 2) if doc == 6 else None

    want = []
    for doc, text in plain(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        if doc == 6 and w:
            w = w[:1] + [w[1 + i % 2] for i in range(len(w) - 1)]
        found = brute(w) if len(w) < 3000 else [Run(0, len(w), 10)]
        drop = set()
        for r in found:
            drop |= set(range(r.start + r.period, r.start + r.length))
        best = min(found, key=lambda r: (-r.length, r.start, r.period), default=None)
        want.append((doc, len(w), len(found), *(best or (None,) * 3), best and 1000 * best.length // best.period,
                     "".join(f"{a},{b},{c}\n" for a, b, c in found), " ".join(x for i, x in enumerate(w) if i not in drop)))
    got = [tuple(r) for r in runs.find(documents(spark, rows), repeat).drop("n_dropped").collect()]
    same(got, want)
    assert runs.find(documents(spark, [])).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    with_runs = 0
    for doc, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, h = len(w), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 4000:
            continue
        found = brute(w)
        with_runs += bool(found)
        drop = {i for r in found for i in range(r.start + r.period, r.start + r.length)}
        r = got[doc]
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest()
        best = min(found, key=lambda r: (-r.length, r.start, r.period), default=(None,) * 3)
        assert (r.start, r.length, r.period) == tuple(best)
    assert with_runs > 5
