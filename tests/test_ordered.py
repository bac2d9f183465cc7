"""Running values over chunks against plain loops, with one key holding most rows."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracklane.operators import keyed, stateful
from tracklane.operators.asof import asof_join
from tracklane.operators.ordered import CHUNK, High, History, Last, Low, Prev, Total, done, scan, split_hot
from tracklane.operators.stateful import deadband, deadband_step, debounce, debounce_step
from tracklane.streaming.keyed import phase_step

ORDER = ["generation_ts", "seq"]


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(5)
    rows, ts = [], 0
    for i in range(1500):
        ts += rnd.choice([0, 1, 3, 40])
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(6)}"
        rows.append((key, ts, i, rnd.choice([None, None, rnd.randrange(9)]), rnd.choice([None, "a", "a", "b"]), rnd.random() * 4))
    return pd.DataFrame(rows, columns=["key", "generation_ts", "seq", "v", "who", "m"])


@pytest.fixture(scope="module")
def df(spark, data):
    rows = [
        (r.key, r.generation_ts, r.seq, None if r.v != r.v else int(r.v), r.who if isinstance(r.who, str) else None, r.m)
        for r in data.itertuples()
    ]
    return spark.createDataFrame(rows, "key string, generation_ts bigint, seq bigint, v bigint, who string, m double").repartition(4)


@pytest.mark.parametrize("width", [7, 100, 10**9])
def test_scan_matches_loop(df, data, width):
    v = F.col("v")
    out = done(scan(
        df, ["key"], ORDER, width, Last("last", v), Last("before", v, inclusive=False), Total("total", v),
        Total("earlier", v, inclusive=False), High("high", v), Low("low", v, inclusive=False), Prev("prev", v), History("hist", v, 3),
    ))
    got = {r["seq"]: r for r in out.collect()}
    assert len(got) == len(data)
    for _, group in data.groupby("key"):
        seen, prev = [], None
        for r in group.sort_values(ORDER).itertuples():
            x = None if r.v is None or r.v != r.v else int(r.v)
            g = got[r.seq]
            assert g["before"] == (seen[-1] if seen else None) and g["earlier"] == sum(seen)
            assert g["low"] == (min(seen) if seen else None) and g["prev"] == prev
            seen += [] if x is None else [x]
            assert g["last"] == (seen[-1] if seen else None) and g["total"] == sum(seen)
            assert g["high"] == (max(seen) if seen else None) and g["hist"] == seen[::-1][:3]
            prev = x


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_join_matches_loop(df, data, inclusive):
    left, right = df.filter("who is null").drop("v"), df.filter("who = 'b'")
    got = {r["seq"]: r["found"] for r in asof_join(left, right, ["key"], {"found": F.col("seq")}, 50, inclusive=inclusive).collect()}
    b = data[data.who == "b"]
    for r in data[data.who.isna()].itertuples():
        old = b[(b.key == r.key) & ((b.generation_ts <= r.generation_ts) if inclusive else (b.generation_ts < r.generation_ts))]
        assert got[r.seq] == (None if old.empty else old.sort_values(ORDER).seq.iloc[-1])


@pytest.mark.parametrize("width", [20, 10**9])
def test_phase_events_match_loop(df, data, width):
    got = sorted(tuple(r) for r in keyed.phase_events(df, ["key"], ORDER, width, F.col("who"), []).select("seq", "identity", "phase", "event_no").collect())
    want = []
    for _, group in data.groupby("key"):
        out = phase_step("who")(group.sort_values(ORDER), None)[0]
        want += list(out[["seq", "identity", "phase", "event_no"]].itertuples(index=False, name=None))
    assert got == sorted(want)


@pytest.mark.parametrize("width", [10, 90, 300, 10**9])
def test_debounce_and_deadband_match_loop(df, data, width, monkeypatch):
    monkeypatch.setattr(stateful, "MAX_KEY_ROWS", 20 if width < 10**9 else 10**9)  # cut keys into chunks, or leave them whole
    kept = sorted(r["seq"] for r in debounce(df, ["key"], 90, width).collect())
    moved = sorted(r["seq"] for r in deadband(df, ["key"], ["m"], 2.0, width).collect())
    loop = lambda step: sorted(s for _, g in data.groupby("key") for s in step(g.sort_values(ORDER), None)[0].seq)
    assert kept == loop(debounce_step(90)) and moved == loop(deadband_step(["m"], 2.0))


@pytest.mark.parametrize("width", [100, 700, 10**9])
def test_greedy_rules_take_null_keys_times_and_measures(spark, width, monkeypatch):
    monkeypatch.setattr(stateful, "MAX_KEY_ROWS", 20 if width < 10**9 else 10**9)
    rnd = random.Random(width)
    nan = float("nan")
    rows = [(k, None if i % 97 == 0 else 100 * i, i, rnd.choice([None, nan, float(rnd.randint(0, 40))]), rnd.choice([None, 1.0, 9.0]))
            for k in ("a", None) for i in range(150)]
    rows += [("c", 100 * i, i, v, None) for i, v in enumerate([None, 1.0, 50.0, 90.0])]
    df = spark.createDataFrame(rows, "key string, generation_ts bigint, seq bigint, m double, n double")

    def loop(rule):
        out = []
        for key in ("a", None, "c"):
            out += [(key, r[2]) for r in rule(sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: r[1:3]))]
        return sorted(out, key=repr)

    def spaced(group):
        last = None
        for r in group:
            if last is None or r[1] - last > 250:
                last = r[1]
                yield r

    def moved(group):
        kept = [None, None]
        for r in group:
            far = [v is not None and v == v and (k is None or abs(k - v) > 5) for k, v in zip(kept, r[3:])]
            kept = [v if f else k for f, v, k in zip(far, r[3:], kept)]
            if any(far):
                yield r

    got = lambda d: sorted(((r["key"], r["seq"]) for r in d.collect()), key=repr)
    assert got(debounce(df, ["key"], 250, width)) == loop(spaced)
    assert got(deadband(df, ["key"], ["m", "n"], 5.0, width)) == loop(moved)


def test_null_keys_are_refused(spark):
    df = spark.createDataFrame([("a", 1, 1, 1.0), (None, 2, 2, 2.0)], "key string, generation_ts bigint, seq bigint, v double")
    with pytest.raises(Exception, match="null key"):
        keyed.latest_value(df, ["key"], ORDER, 10, F.col("v"), "last").collect()


def test_debounce_accepts_backwards_clock():
    pdf = pd.DataFrame({"generation_ts": [100, 105, 50, 55]})
    assert debounce_step(10)(pdf, None)[0].generation_ts.tolist() == [100, 50]


def test_emit_on_change(df, data):
    got = sorted(r["seq"] for r in keyed.emit_on_change(df, ["key"], ORDER, 60, F.col("who")).collect())
    want = []
    for _, g in data.groupby("key"):
        last = object()
        for r in g.sort_values(ORDER).itertuples():
            if r.who != last:
                want.append(r.seq)
            last = r.who
    assert got == sorted(want)


@pytest.mark.parametrize("threshold", [25, 200])
def test_active_key_ticks_match_loop(df, data, threshold):
    got = sorted(tuple(r) for r in keyed.active_key_ticks(df, "key", 10, threshold, 70).collect())
    want = []
    for key, g in data.groupby("key"):
        times = sorted(g.generation_ts)
        for b in range(math.ceil(times[0] / 10), math.ceil(times[-1] / 10) + 1):
            last = max(t for t in times if t <= b * 10)
            if b * 10 - last <= threshold:
                want.append((key, b * 10, last))
    assert got == sorted(want)


@pytest.mark.parametrize("max_rows", [5, 100])
def test_split_hot_bounds_chunks_and_keeps_results(df, data, max_rows):
    cut = split_hot(df, ["key"], "generation_ts", 10_000, max_rows)
    sizes = cut.groupBy("key", CHUNK).agg(F.count("*").alias("n"), F.countDistinct("generation_ts").alias("times"))
    assert sizes.filter(f"n > {max_rows} and times > 1").count() == 0
    a = done(scan(cut, ["key"], ORDER, 10_000, Total("t", F.col("v")), Prev("p", F.col("v"))))
    b = done(scan(df, ["key"], ORDER, 10**9, Total("t", F.col("v")), Prev("p", F.col("v"))))
    read = lambda d: sorted(tuple(r) for r in d.select("seq", "t", F.coalesce("p", F.lit(-1))).collect())
    assert read(a) == read(b) and len(read(a)) == len(data)


def test_plan_spreads_one_key(df):
    """The rows are partitioned by key and chunk, never by the key alone."""
    plan = scan(df, ["key"], ORDER, 50, Total("t", F.col("v")))._jdf.queryExecution().toString()
    assert "windowspecdefinition(key" in plan and "__chunk" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
