"""Descriptions of chunks, composed in order, leave the state that the sequential rule leaves."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracklane.operators import stateful
from tracklane.operators.speed import DRIBBLING, _dribble, _dribble_chunk
from tracklane.params import Params

P = Params().with_(dribble_ms=350)
COLUMNS = ["match_id", "generation_ts", "seq", "object_id", "team_id", "holder_player", "vabs", "x", "y", "z"]


def holder_rows(rnd, n):
    """Rows of holders and former holders: runs of fast and slow readings, with ties of time."""
    rows, ts, holder = [], 0, "a"
    for seq in range(n):
        ts += rnd.choice([0, 50, 50, 100, 400])
        if rnd.random() < 0.2:
            holder = rnd.choice(["a", "b", "c", None])
        player = holder if holder and rnd.random() < 0.8 else rnd.choice("abc")
        fast = rnd.random() < 0.8
        rows.append(("m", ts, seq, player, "T", holder, P.dribble_speed + 1 if fast else 0.0, rnd.uniform(0, 9), rnd.uniform(0, 9), 0.0))
    return rows


def near(a, b):
    return len(a) == len(b) and all(abs(x - y) < 1e-6 if isinstance(x, float) else near(x, y) if isinstance(x, list) else x == y for x, y in zip(a, b))


def test_dribblings_compose():
    rnd = random.Random(1)
    step, (describe, follow) = _dribble(P), _dribble_chunk(P)
    kinds = set()
    for _ in range(400):
        pdf = pd.DataFrame(holder_rows(rnd, rnd.randint(1, 60)), columns=COLUMNS)
        cuts = sorted(rnd.sample(range(len(pdf) + 1), min(len(pdf), rnd.randint(0, 8))))
        state, known = None, None
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            if a == b:
                continue
            chunk = pdf.iloc[a:b]
            known = step(chunk, known)[1]
            state = follow(state, json.loads(json.dumps(describe(chunk))))
            assert near(state, known), (state, known)
            kinds.add((known[0] is not None, known[4] is not None))
    assert kinds == {(False, False), (True, False), (False, True)}


@pytest.mark.parametrize("max_rows", [7, 1000])
def test_dribblings_of_a_hot_key(spark, max_rows):
    rows = holder_rows(random.Random(2), 1500)
    want = _dribble(P)(pd.DataFrame(rows, columns=COLUMNS), None)[0]
    df = spark.createDataFrame(rows, "match_id string, generation_ts long, seq long, object_id string, team_id string, holder_player string, vabs double, x double, y double, z double")
    got = stateful.chunked_scan(df, ["match_id"], ["generation_ts", "seq"], 5000, _dribble(P), *_dribble_chunk(P), schema=DRIBBLING, max_rows=max_rows)
    read = lambda rows: sorted((r[2], r[5], r[6], round(r[7], 6)) for r in rows)
    assert len(want) > 50 and read(got.collect()) == read(want.itertuples(index=False))


def test_rising_values_have_small_descriptions():
    """A strictly rising measure is all records: a description holds those within reach only."""
    describe, follow = stateful.deadband_chunk(["v"], 5.0)
    values = np.arange(0, 20_000, 0.25)
    step, state, known = stateful.deadband_step(["v"], 5.0), None, None
    for i in range(0, len(values), 5000):
        chunk = pd.DataFrame({"v": values[i:i + 5000]})
        said = describe(chunk)
        assert len(json.dumps(said)) < 5000
        state, known = follow(state, said), step(chunk, known)[1]
        assert state == known


def test_a_hot_key_of_rising_values(spark, monkeypatch):
    """One key holds most rows, all of them new maxima; no task gets more than the stated rows of it."""
    monkeypatch.setattr(stateful, "MAX_KEY_ROWS", 8_000)
    hot = spark.range(60_000).selectExpr("'hot' as key", "id * 3 as generation_ts", "id as seq", "cast(id as double) / 7 as v")
    calm = spark.range(900).selectExpr("concat('k', id % 30) as key", "id * 10 as generation_ts", "id as seq", "cast(id % 50 as double) as v")
    df = hot.unionByName(calm)
    sizes = []
    inner = stateful.split_hot

    def watched(rows, *args):
        out = inner(rows, *args)
        sizes.append(out.groupBy("key", stateful.CHUNK).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(stateful, "split_hot", watched)
    got = stateful.deadband(df, ["key"], ["v"], 5.0, 10**9).groupBy("key").agg(F.sort_array(F.collect_list("seq")).alias("s")).collect()
    assert sizes and max(sizes) <= 8_000
    want = {}
    for key, values in {"hot": np.arange(60_000) / 7, **{f"k{k}": None for k in range(30)}}.items():
        seqs = np.arange(60_000) if key == "hot" else np.arange(int(key[1:]), 900, 30)
        values = values if key == "hot" else (seqs % 50).astype(float)
        last, kept = None, []
        for s, v in zip(seqs.tolist(), values.tolist()):
            if last is None or abs(v - last) > 5.0:
                last = v
                kept.append(s)
        want[key] = kept
    assert {r.key: r.s for r in got} == want
