"""Movement operators on hand-made rows with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracklane.functions import geometry as geo
from tracklane.operators import heatmap, offside, passes, prepare, setplay, speed, teamarea
from tracklane.params import AREAS_TEXT, Params
from tracklane.plans.catalog import PARAMS

P = PARAMS
STATE = "match_id string, generation_ts bigint, seq bigint, object_id string, team_id string, x double, y double, z double, vabs double"


def test_field_object_state_scales_renames_and_mirrors(spark):
    raw = spark.createDataFrame(
        [("m", 0, 0, "BALL", "BALL", 1.0, 1.0, 0.0), ("m", 500, 1, "BALL", "BALL", 2.0, 1.0, 1.0)],
        "match_id string, generation_ts bigint, seq bigint, object_id string, team_id string, x double, y double, z double",
    )
    meta = spark.createDataFrame(
        [("m", 105.0, 68.0, True, False, "{BALL:ball}%{A1:one}", "", AREAS_TEXT)],
        "match_id string, field_length double, field_width double, mirrored_x boolean, mirrored_y boolean, object_rename_map string, team_rename_map string, areas string",
    )
    out = prepare.field_object_state(raw, meta, P.with_(chunk_ms=300)).orderBy("seq").collect()
    assert [r["object_id"] for r in out] == ["ball", "ball"] and out[0]["vabs"] == 0
    assert (out[1]["x"], out[1]["vx"], out[1]["vz"]) == (-2.0, -2.0, 2.0) and out[1]["vabs"] == pytest.approx(math.sqrt(8))
    assert out[0]["areas"] == ["field", "centerThird"]


def test_metadata_as_of_the_time_of_a_reading(spark):
    raw = spark.createDataFrame(
        [("m", t, i, "BALL", "BALL", 2.0, 1.0, 0.0) for i, t in enumerate((0, 100, 200, 300))] + [("other", 0, 0, "BALL", "BALL", 2.0, 1.0, 0.0)],
        "match_id string, generation_ts bigint, seq bigint, object_id string, team_id string, x double, y double, z double",
    )
    meta = spark.createDataFrame(
        [("m", 0, 0, 105.0, 68.0, False, False, "", "", AREAS_TEXT), ("m", 200, 1, 105.0, 68.0, True, False, "", "", AREAS_TEXT)],
        "match_id string, generation_ts bigint, seq bigint, field_length double, field_width double, mirrored_x boolean, mirrored_y boolean, "
        "object_rename_map string, team_rename_map string, areas string",
    )
    out = prepare.field_object_state(raw, meta, P.with_(chunk_ms=150)).orderBy("match_id", "seq").collect()
    assert [r["x"] for r in out] == [2.0, 2.0, -2.0, -2.0, 2.0]
    doubled = prepare.field_object_state(raw, meta.drop("generation_ts", "seq"), P).count()
    assert doubled == 5


def test_long_sequences_keep_their_length(spark):
    p = _passes(spark, [(1000 * i, "successful_pass", "A", f"A{i % 2}", f"A{1 - i % 2}") for i in range(150)])
    areas = spark.createDataFrame([], "match_id string, generation_ts bigint, seq bigint, object_id string, area_id string, in_area boolean")
    chains = passes.pass_chains(p, areas, P.with_(chunk_ms=7000)).orderBy("generation_ts").collect()
    assert [r["length"] for r in chains] == list(range(1, 151)) and chains[-1]["first_ts"] == 0


@pytest.mark.parametrize("points,area", [
    ([(0, 0), (4, 0), (4, 3), (0, 3), (2, 1)], 12.0),
    ([(0, 0), (4, 0), (4, 3), (0, 3), (2, 0), (4, 3), (0, 0)], 12.0),
    ([(0, 0), (1, 1), (2, 2), (3, 3)], 0.0),
    ([(1, 1), (1, 1), (1, 1)], 0.0),
    ([(0, 0), (1, 0), (0, 1)], 0.5),
])
def test_hull(spark, points, area):
    xs, ys = [float(p[0]) for p in points], [float(p[1]) for p in points]
    df = spark.createDataFrame([(xs, ys)], "xs array<double>, ys array<double>")
    assert df.select(teamarea.hull_surface("xs", "ys").alias("a")).first()["a"] == pytest.approx(area)


def test_mbr_quirk(spark):
    df = spark.createDataFrame([([-4.0, -2.0], [-3.0, -1.0])], "xs array<double>, ys array<double>")
    pick = lambda q: df.select(teamarea.mbr_surface(F.col("xs"), F.col("ys"), q).alias("a")).first()["a"]
    assert pick(False) == 4.0 and pick(True) == pytest.approx(12.0)


def test_angles(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0)], "a double, b double, c double, d double")
    zero = F.lit(0.0)
    got = [r[0] for r in df.select(geo.angle3((F.col("a"), F.col("b"), zero), (F.col("c"), F.col("d"), zero))).collect()]
    assert got[0] == pytest.approx(math.pi / 2) and got[1] is None


MATCHED = (
    "match_id string, generation_ts bigint, kick_ts bigint, kind int, area_id string, receiver_team string, end_x double, end_y double, "
    "end_z double, end_zone string, left_team string, kicker_team string, kick_x double, kick_y double, kick_z double, attacked boolean, "
    "kick_zone string, kicker_nearer int, receiver_nearer int"
)


def _kick(kind, area, team, z, end_zone, kicker, attacked, zone):
    return ("m", 1000, 0, kind, area, team, 10.0, 0.0, z, end_zone, "A", kicker, 0.0, 0.0, 0.0, attacked, zone, 5, 3)


@pytest.mark.parametrize("kick,want", [
    (_kick(1, "", "A", 0.0, "left", "A", True, "left"), "successful_pass"),
    (_kick(1, "", "B", 0.0, "center", "A", True, "left"), "clearance"),
    (_kick(1, "", "B", 0.0, "right", "A", True, "left"), "clearance"),
    (_kick(1, "", "B", 0.0, "left", "A", True, "left"), "interception"),
    (_kick(1, "", "A", 0.0, "left", "B", True, "right"), "clearance"),
    (_kick(1, "", "B", 0.0, "center", "A", True, "center"), "interception"),
    (_kick(0, "leftGoal", None, 1.0, None, "A", True, "left"), "goal"),
    (_kick(0, "leftGoal", None, 3.0, None, "A", True, "left"), "clearance"),
    (_kick(0, "leftGoal", None, 3.0, None, "A", False, "left"), "misplaced_pass"),
    (_kick(0, "rightGoal", None, 3.0, None, "A", False, "left"), "shot_off_target"),
    (_kick(0, "rightGoal", None, 3.0, None, "B", False, "left"), "misplaced_pass"),
    (_kick(0, "slightlyAboveRightGoal", None, 0.0, None, "A", False, "center"), "shot_off_target"),
    (_kick(0, "slightlyBelowLeftGoal", None, 0.0, None, "A", False, "center"), "misplaced_pass"),
    (_kick(0, "slightlyBelowLeftGoal", None, 0.0, None, "A", True, "left"), "clearance"),
    (_kick(0, "aboveRightGoal", None, 0.0, None, "A", False, "center"), "misplaced_pass"),
    (_kick(0, "aboveCenterThird", None, 0.0, None, "B", True, "right"), "clearance"),
])
def test_outcomes(spark, kick, want):
    r = passes.pass_events(spark.createDataFrame([kick], MATCHED), P).first()
    assert r["outcome"] == want and r["length"] >= 10.0
    assert r["packing"] == (2 if want == "successful_pass" else None)


@pytest.mark.parametrize("dx,dy,team,want", [
    (1.0, 0.0, "A", "FORWARD"), (-1.0, 0.0, "A", "BACKWARD"), (0.0, 1.0, "A", "RIGHT"), (0.0, -1.0, "A", "LEFT"),
    (1.0, 0.0, "B", "BACKWARD"), (0.0, 1.0, "B", "LEFT"), (0.0, -1.0, "B", "RIGHT"),
])
def test_directions(spark, dx, dy, team, want):
    df = spark.createDataFrame([("m", 2000, 0, dx, dy, 0.0, 0.0, 0.0, 0.0, team, "A")],
                               "match_id string, generation_ts bigint, kick_ts bigint, end_x double, end_y double, end_z double, kick_x double, kick_y double, kick_z double, kicker_team string, left_team string")
    r = passes.pass_geometry(df, P).first()
    assert r["direction"] == want and r["velocity"] == pytest.approx(0.5)


def _passes(spark, events):
    rows = [("m", ts, i, o, t, k, r) for i, (ts, o, t, k, r) in enumerate(events)]
    return spark.createDataFrame(rows, "match_id string, generation_ts bigint, seq bigint, outcome string, kicker_team string, kicker string, receiver string")


def test_pass_chains_and_statistics(spark):
    ok = "successful_pass"
    p = _passes(spark, [
        (1000, ok, "A", "A1", "A2"), (3000, ok, "A", "A2", "A1"), (5000, ok, "A", "A1", "A3"),
        (6000, "interception", "A", "A3", "B1"), (7000, ok, "A", "A3", "A4"), (18000, ok, "A", "A4", "A5"),
        (19000, ok, "A", "A6", "A7"), (20000, ok, "B", "A7", "B2"),
    ])
    areas = spark.createDataFrame([], "match_id string, generation_ts bigint, seq bigint, object_id string, area_id string, in_area boolean")
    q = P.with_(chunk_ms=2000)
    chains = passes.pass_chains(p, areas, q)
    got = [(r["generation_ts"], r["length"], r["first_ts"]) for r in chains.orderBy("generation_ts").collect()]
    assert got == [(1000, 1, 1000), (3000, 2, 1000), (5000, 3, 1000), (7000, 1, 7000), (18000, 1, 18000), (19000, 1, 19000), (20000, 1, 20000)]
    assert [r["generation_ts"] for r in passes.double_pass(chains).collect()] == [3000]
    stat = {(r["generation_ts"], r["item"]): (r["num"], r["avg_length"], r["max_length"], r["num_double"])
            for r in passes.pass_sequence_statistics(chains, q).collect()}
    assert stat[(3000, "A")] == (1, 2.0, 2, 1) and stat[(5000, "A1")] == (1, 3.0, 3, 1) and stat[(5000, "A3")] == (1, 3.0, 3, 0)
    short = passes.pass_chains(p, areas, q.with_(pass_history=2))
    assert max(r["length"] for r in short.collect()) == 2


def test_offside(spark):
    roster = P.roster
    xs = {o: (-20.0 + i if t == "A" else 10.0 + i) for i, (o, t) in enumerate(roster)}
    xs.update(A1=5.0, A2=30.0, B11=40.0, B10=25.0)
    rows = [("m", 100, i, o, t, xs[o], 0.0, 0.0, 0.0) for i, (o, t) in enumerate(roster)] + [("m", 200, 50, "A1", "A", 5.0, 0.0, 0.0, 0.0)]
    states = spark.createDataFrame(rows, STATE)
    change = spark.createDataFrame([("m", 150, 40, "A1", "A")], "match_id string, generation_ts bigint, seq bigint, player_id string, team_id string")
    kick = spark.createDataFrame([("m", 0, 0, "A")], "match_id string, generation_ts bigint, seq bigint, left_team string")
    out = offside.offside_line(states, change, kick, P).orderBy("generation_ts", "seq").collect()
    assert [(r["generation_ts"], r["player_id"]) for r in out] == [(100, None), (200, "A1")]
    second = sorted((x for o, x in xs.items() if o[0] == "B"), reverse=True)[1]
    assert out[1]["offside_x"] == second
    assert sorted(out[1]["players_in_offside"]) == sorted(o for o, x in xs.items() if o[0] == "A" and x > second)


@pytest.mark.parametrize("x,y,team,kind", [
    (-50.0, 0.0, "A", "goalkick"), (-50.0, 0.0, "B", "penalty"), (50.0, 0.0, "A", "penalty"), (50.0, 0.0, "B", "goalkick"),
    (52.0, 33.0, "A", "cornerkick"), (0.0, 0.0, "B", "freekick"),
])
def test_set_plays(spark, x, y, team, kind):
    areas_of = spark.range(1).select(prepare.areas_at(prepare.parse_areas(F.lit(AREAS_TEXT)), F.lit(x), F.lit(y)).alias("areas")).first()["areas"]
    v = [0.0] * 5 + [5.0]
    frames = spark.createDataFrame(
        [("m", 1000 + 200 * i, i, x, y, 0.0, s, areas_of, [(f"{team}1", team, x + 1, y, 0.0)]) for i, s in enumerate(v)],
        "match_id string, generation_ts bigint, seq bigint, x double, y double, z double, vabs double, areas array<string>, "
        "players array<struct<object_id:string,team_id:string,x:double,y:double,z:double>>",
    )
    empty = spark.createDataFrame([], "match_id string, generation_ts bigint, seq bigint, object_id string, area_id string, in_area boolean")
    kick = spark.createDataFrame([("m", 0, 0, "A")], "match_id string, generation_ts bigint, seq bigint, left_team string")
    got = setplay.set_play(frames, empty, kick, P.with_(chunk_ms=500)).collect()
    assert [(r["generation_ts"], r["kind"], r["player_id"]) for r in got] == [(2000, kind, f"{team}1")]


def _dribble_loop(rows, holders, p):
    """The rule on every player row, without leaving any out."""
    who = wait = since = None
    out = []
    for ts, player, v in rows:
        h = holders[ts]
        if who and h != who:
            if player == who:
                out.append((ts, player, "END"))
                who = None
        elif player == h:
            if v >= p.dribble_speed:
                if who:
                    out.append((ts, player, "ACTIVE"))
                elif wait is None:
                    wait, since = player, ts
                elif wait == player:
                    if ts - since > p.dribble_ms:
                        who, wait = player, None
                        out.append((ts, player, "START"))
                else:
                    wait = None
            elif who:
                out.append((ts, player, "END"))
                who = None
            else:
                wait = None
    return out


def test_dribbling_matches_loop(spark):
    rnd = random.Random(3)
    names, rows, holders, changes, holder = ["A1", "A2", "B1"], [], {}, [], None
    for t in range(400):
        ts = 200 * (t + 1)
        if rnd.random() < 0.06:
            holder = rnd.choice(names + [None])
            changes.append(("m", ts, 3 * t, holder, holder[0] if holder else None))
        holders[ts] = holder
        for i, n in enumerate(names):
            if rnd.random() < 0.9:
                rows.append((ts, 3 * t + i, n, 3.0 if rnd.random() < 0.93 else 1.0))
    states = spark.createDataFrame([("m", ts, s, n, n[0], float(ts), 0.0, 0.0, v) for ts, s, n, v in rows], STATE)
    ch = spark.createDataFrame(changes, "match_id string, generation_ts bigint, seq bigint, player_id string, team_id string")
    got = speed.dribbling_event(states, ch, P.with_(chunk_ms=5000)).orderBy("seq").collect()
    want = _dribble_loop([(ts, n, v) for ts, _, n, v in rows], holders, P)
    assert [(r["generation_ts"], r["player_id"], r["phase"]) for r in got] == want and len(want) > 50
    assert all(r["length"] == 0 and r["duration"] == 0 for r in got if r["phase"] == "START")


def test_heatmap_text(spark):
    p = Params().with_(grid_x=2, grid_y=3, intervals_s=(0, 2), chunk_ms=2000)
    cells = spark.createDataFrame(
        [("m", 0, 0, "A1", "A", 0, 1), ("m", 100, 1, "A1", "A", 0, 1), ("m", 1000, 2, "A1", "A", 1, 2), ("m", 3500, 3, "A1", "A", 0, 0)],
        "match_id string, generation_ts bigint, seq bigint, object_id string, team_id string, cell_x bigint, cell_y bigint",
    )
    spans = heatmap.item_seconds(cells, p)
    out = heatmap.heatmap_rle(heatmap.heatmap_interval(heatmap.heatmap_second(cells), spans, p), spans, p)
    got = {(r["interval_s"], r["second"]): (r["total"], r["cells"]) for r in out.filter("item = 'A'").collect()}
    assert got == {
        (0, 0): (2, "0x1;2;0x4"), (0, 1): (3, "0x1;2;0x3;1"), (0, 2): (3, "0x1;2;0x3;1"), (0, 3): (4, "1;2;0x3;1"),
        (2, 0): (2, "0x1;2;0x4"), (2, 1): (3, "0x1;2;0x3;1"), (2, 2): (1, "0x5;1"), (2, 3): (1, "1;0x5"),
    }


def test_explode_range(spark):
    df = spark.createDataFrame([(1, 0, 5000), (2, 3, 2), (3, -3, -3)], "id int, a bigint, b bigint")
    got = heatmap.explode_range(df, F.col("a"), F.col("b"), "n", block=64).groupBy("id").agg(F.count("*"), F.min("n"), F.max("n")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 5001, 0, 5000), (3, 1, -3, -3)]


def test_chunks_do_not_change_results(spark):
    """Short chunks give what one chunk per match gives, through the whole chain of stages."""
    from tracklane.plans.match import Match

    sf = "/root/testdata/sf0.001"
    cut, whole = (Match.from_events(spark, sf, P.with_(chunk_ms=w)) for w in (1000, 10**12))
    for stage in ("changes", "duels", "pressure", "kicks", "set_plays"):
        a, b = getattr(cut, stage), getattr(whole, stage)
        cols = [c for c in a.columns if c != "pressing_index"]
        assert a.count() == b.count() and a.select(cols).exceptAll(b.select(cols)).count() == 0
