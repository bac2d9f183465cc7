import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import CLASH, same
from tracklane.llm import prefix_trie
from tracklane.llm.prefix_trie import numbered, shared, trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def head_of(c):
    return zlib.crc32(str(c).encode()) % 9


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {c: t if c % 5 == 0 else own.get(c - int(math.fmod(c, 5)), [])[:head_of(c)] + t[head_of(c):] for c, t in own.items()}
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
            for p, m in members.items()]


def spark_trie(spark, rows, clash=True):
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if clash:
        d = d.withColumns({c: F.lit("clash") for c in [*CLASH, "pos", "digest", "depth", "ka", "chunk", "length", "bytes", "base", "piece"]})
    turns = shared(numbered(d), 5, F.crc32(F.col("conv_id").cast("string")) % 9, 8)
    return [tuple(r) for r in trie(turns).select(*COLUMNS).collect()]


CASES = [
    (0, None, None, None), (0, 3, "user", "é" * 10), (0, 3, "assistant", ""), (0, 7, "user", "long " * 5000), (1, 1, "user", "only"),
    (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 1, "user", "nobody"), (6, 5, "user", "base is absent"), (6, 6, None, "x"),
    (7, 5, "user", "base is absent"), (10, 1, "u", "same"), (11, 1, "u", "same"), (15, 1, "u", "same"), (-3, 1, "u", "same"), (-5, 0, "u", "neg"),
    *[(20, i, "user", f"turn {i}") for i in range(60)], *[(21, i, "user", f"turn {i}") for i in range(60)],
    *[(25, i, "user", f"turn {i}" if i != 40 else "other") for i in range(45)],
    *[(c, i, "user" if i % 2 == 0 else "assistant", f"t{i}" if i < 2 else f"{c % 7} {i}") for c in range(100, 300) for i in range(c % 6 + 1)],
]


def test_equals_brute_force(spark):
    same(spark_trie(spark, CASES), brute(CASES))


@pytest.mark.parametrize("band", [2, 3])
def test_several_bands_and_pieces(spark, monkeypatch, band):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    monkeypatch.setattr(prefix_trie, "HOT_SHARE", 40)
    rng = np.random.default_rng(7)
    rows = [(int(c), int(t), str(rng.integers(0, 2)), str(rng.integers(0, 2))) for c in rng.choice(400, 60, False) for t in range(rng.integers(1, 30))]
    rows += [r for r in CASES if r[0] in (20, 21, 25, None, 0, 1, 2)]
    rows = [r for i, r in enumerate(rows) if r not in rows[:i] or r[0] == 2]
    same(spark_trie(spark, rows, clash=False), brute(rows))


def test_no_conversation(spark):
    assert spark_trie(spark, [], clash=False) == []
    assert spark_trie(spark, [(None, 1, "user", "x")]) == []


def test_explosion_is_bounded(spark, monkeypatch):
    """A chain of n turns makes at most BAND rows a node and level."""
    members = spark.range(5000).selectExpr("1L as conv_id", "id as depth", "id as ka", "id as kb")
    values = members.selectExpr("*", "cast(depth = 4999 as long) as leaves", "1L as saved")
    seen = []
    whole = prefix_trie._given_up

    def counted(values, members, step, above):
        out = whole(values, members, step, above)
        seen.append((step, above))
        return out

    monkeypatch.setattr(prefix_trie, "_given_up", counted)
    got = {r.ka: (r.leaves, r.saved) for r in prefix_trie.rollup(values, members, 4999).collect()}
    assert got == {i: (1, 5000 - i) for i in range(5000)}
    assert len(seen) <= 2 * 4
