import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracklane.llm import simhash
from tracklane.llm.components import components


def brute_components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


DOCS = [(1, "The quick brown fox jumps over the lazy dog"), (2, "the QUICK brown fox jumps over the lazy dog"), (3, None),
        (4, ""), (5, " \n"), (6, "one"), (7, "one two"), (8, "ÄÖÜ écru no break"), (9, "a b c " * 3000), (9, "a b c " * 3000),
        (None, "One"), (None, "alone here with nobody else"), (10, "x")]


def test_fingerprints_and_cases(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("label", F.lit(1))
    got = sorted(simhash.near_duplicates(docs).collect(), key=repr)
    assert len(got) == len(DOCS)
    want = {d: f"{brute_fingerprint(t):016x}" for d, t in DOCS if d is not None}
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == want[r.doc_id]
    ids = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert ids[2] == 1 and ids[3] == ids[4] == ids[5] == 3
    assert {r.component_id for r in got if r.doc_id is None} == {6, None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert len({r.component_id for r in got}) == kept.count()


@pytest.mark.parametrize("most", [16_384, 40])
def test_links_connect_what_brute_force_does(spark, most):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    dense = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centre for _ in range(250)]
    fps = sorted({*dense, *map(int, rng.integers(0, 1 << 63, 200, dtype=np.uint64)), 0})
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3]
    to = dict(zip(fps, signed))
    want = brute_components(signed, [(to[a], to[b]) for a, b in pairs])
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), most)
    got = {f: f for f in signed} | {r.node: r.label for r in components(found).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == groups(want)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, j) for j in range(1001, 1200)] + [(5, 5), (None, 4)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[j] for j in range(1000, 1200)} == {1000}
