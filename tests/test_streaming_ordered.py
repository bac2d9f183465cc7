"""Rows that arrive out of order, in several micro-batches, give the batch result."""

import random

import pytest
from pyspark.sql import functions as F

from tracklane.operators import heatmap, passes
from tracklane.operators.asof import asof_join, snapshot_asof
from tracklane.params import OUTSIDE_AREAS, Params
from tracklane.session import materialize, work_dir
from tracklane.streaming import ordered as live
from tracklane.streaming.run import out_of_order, run_available

LATE = 900
END = {"match_id": "end", "seq": 0}
KEYS = ["match_id"]


@pytest.fixture(scope="module")
def readings(spark):
    rnd = random.Random(5)
    rows = [(f"m{i % 3}", 1000 + 100 * (i // 6), i, rnd.choice(["a", "b", "c"]), rnd.choice([None, 1.0, 2.5]), rnd.random() < 0.3) for i in range(600)]
    return materialize(spark.createDataFrame(rows, "match_id string, generation_ts long, seq long, object_id string, x double, hit boolean"), "readings")


def same(stream, batch, cols):
    read = lambda d: sorted(repr(r) for r in d.filter("match_id <> 'end'").select(*cols).collect())
    got, want = read(run_available(stream, "ordered")), read(batch)
    assert want and got == want


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_join(readings, inclusive):
    left, right = readings.filter("hit"), readings.filter("not hit")
    values = {"x_then": F.col("x"), "seq_then": F.col("seq")}
    sources = [out_of_order(t, "asof", LATE, end=END) for t in (left, right)]
    same(live.asof_join_stream(*sources, KEYS, values, late_ms=LATE, inclusive=inclusive),
         asof_join(left, right, KEYS, values, 5000, inclusive=inclusive), ["seq", "x_then", "seq_then"])


def test_snapshots(readings):
    roster = [("a", "A"), ("b", "A"), ("c", "B")]
    source = out_of_order(readings, "snapshots", LATE, end=END)
    same(live.snapshot_stream(source, roster, ["x", "seq"], trigger=F.col("hit"), late_ms=LATE),
         snapshot_asof(readings, roster, ["x", "seq"], 5000, trigger=F.col("hit")), ["match_id", "seq", "objects"])


@pytest.mark.parametrize("forget", [None, 1000])
def test_state_is_evicted(spark, readings, forget):
    """Nothing waits any more but the end marker, and keys are forgotten where that is asked for."""
    source = out_of_order(readings, "evict", LATE, end=END)
    rows = live.snapshot_stream(source, [("a", "A")], ["x"], trigger=F.col("hit"), late_ms=LATE, forget_ms=forget)
    progress = f"{work_dir(spark)}/evict-{random.random()}"
    rows.writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", progress).start().awaitTermination()
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(progress).select("key.*")
    keys = lambda name: {r.match_id for r in state(name).collect()}
    assert keys("waiting") <= {"end"}
    assert keys("latest") == (set() if forget else {"m0", "m1", "m2"})
    assert keys("clock") == ({"end"} if forget else {"m0", "m1", "m2", "end"})


def test_late_rows_are_dropped(spark, readings):
    early = readings.filter("seq >= 300")
    path = materialize(early.coalesce(1), "late").inputFiles()[0].rsplit("/", 1)[0]
    readings.filter("seq < 300").coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("end", 1 << 40, 0, None, None, True)], readings.schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    out = run_available(live.snapshot_stream(source, [("a", "A")], ["x"], trigger=F.col("hit"), late_ms=LATE), "late")
    assert out.filter("match_id <> 'end'").agg(F.min("seq")).first()[0] >= 300


def test_passes(spark):
    """Random kicks, receipts and entries of two matches, with ties of time, kicks without an end and late sides."""
    rnd, p = random.Random(9), Params().with_(pass_max_ms=700)
    tables = {n: [] for n in ("kicks", "changes", "areas", "kickoffs")}
    for seq in range(700):
        who, m, ts = rnd.choice(["A1", "A2", "B1", None]), f"m{seq % 2}", 1000 + 100 * (seq // 3)
        at = (m, ts, seq)
        kind = rnd.choices(list(tables), [6, 3, 2, 0.3])[0]
        if kind == "kicks" and who and seq % 60 > 10:
            tables[kind].append((*at, who, who[0], 1.0, 2.0, 0.0, rnd.randint(0, 5), "left", rnd.random() < 0.5))
        elif kind == "changes":
            tables[kind].append((*at, who, who and who[0], 3.0, 4.0, 0.0, rnd.randint(0, 5), ["field", "leftThird"]))
            if rnd.random() < 0.3:
                tables["areas"].append((*at, p.ball, 7.0, 8.0, 0.0, True, rnd.choice(OUTSIDE_AREAS)))
        elif kind == "areas":
            tables[kind].append((*at, rnd.choice([p.ball, "A1"]), 5.0, 6.0, 0.1, rnd.random() < 0.8, rnd.choice([*OUTSIDE_AREAS, "field"])))
        elif kind == "kickoffs" and seq > 40:
            tables[kind].append((*at, rnd.choice("AB")))
    at, xyz = "match_id string, generation_ts long, seq long, ", lambda n: ", ".join(f"{n}{c} double" for c in "xyz")
    schemas = {
        "kicks": f"{at} player_id string, team_id string, {xyz('player_')}, num_nearer int, zone string, attacked boolean",
        "changes": f"{at} player_id string, team_id string, {xyz('player_')}, num_nearer int, areas array<string>",
        "areas": f"{at} object_id string, {xyz('')}, in_area boolean, area_id string", "kickoffs": f"{at} left_team string"}
    frames = {n: materialize(spark.createDataFrame(rows, schemas[n]), n) for n, rows in tables.items()}
    marks = {"changes": {"player_id": "end"}, "areas": {"object_id": p.ball, "in_area": True, "area_id": OUTSIDE_AREAS[0]}}
    sources = [out_of_order(t, n, LATE, end={**END, **marks.get(n, {})}) for n, t in frames.items()]
    batch = passes.pass_shot_match(*frames.values(), p)
    assert batch.count() > 30
    same(live.pass_shot_match_stream(*sources, p, late_ms=LATE), batch, batch.columns)


def test_heatmap_intervals(spark):
    """Two matches with silent seconds, cells that empty again, and intervals from one second to the whole match."""
    rnd, p = random.Random(4), Params().with_(intervals_s=(0, 1, 3, 5), grid_x=4, grid_y=3)
    rows = [(f"m{i % 2}", 100 * i, i, o, t, rnd.uniform(-60, 60), rnd.uniform(-40, 40), 105.0, 68.0)
            for i in range(400) for o, t in rnd.sample(p.roster, 2) if not 120 < i < 260]
    states = materialize(spark.createDataFrame(
        rows, "match_id string, generation_ts long, seq long, object_id string, team_id string, x double, y double, field_length double, field_width double"), "states")
    cells = heatmap.heatmap_cell(states, p)
    batch = heatmap.heatmap_interval(heatmap.heatmap_second(cells), heatmap.item_seconds(cells, p), p)
    source = out_of_order(states, "intervals", LATE, end={**END, "object_id": p.roster[0][0], "team_id": "x", "x": 0.0, "y": 0.0, "field_length": 105.0, "field_width": 68.0})
    same(live.heatmap_interval_stream(source, p, late_ms=LATE), batch, ["match_id", "item", "interval_s", "cell_x", "cell_y", "second", "n"])
