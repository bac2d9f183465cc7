"""Kicks, passes, shots, pass sequences and their statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.functions.geometry import angle3, norm3
from tracklane.operators.asof import MATCH, ORDER, SEQ, TS, asof_join
from tracklane.operators.keyed import item_rollup
from tracklane.operators.ordered import High, History, Last, Total, done, scan
from tracklane.params import BESIDE_GOALS, GOALS, OUTSIDE_AREAS, THIRDS, Params

PASSES = ("successful_pass", "interception", "misplaced_pass", "clearance")
SHOTS = ("goal", "shot_off_target")
DIRECTIONS = ("FORWARD", "BACKWARD", "LEFT", "RIGHT")


def zone(areas: Column) -> Column:
    """Third of the field: left, center, right or outside."""
    left, center, right = (F.array_contains(areas, t) for t in THIRDS)
    return F.when(left, "left").when(center, "center").when(right, "right").otherwise("outside")


def kick_event(possession: DataFrame, duels: DataFrame, pressure: DataFrame, p: Params) -> DataFrame:
    """The ball gets farther from its holder than the kick distance; near again re-arms."""
    held = possession.filter("player_id is not null and holder_dist is not null")
    far = F.when(F.col("holder_dist") > p.kick_dist, 1).when(F.col("holder_dist") < p.ball_back_dist, 0)
    known = scan(held.withColumn("__far", far), [MATCH], ORDER, p.chunk_ms, Last("__was", F.col("__far"), inclusive=False))
    kicks = known.filter("__far = 1 and coalesce(__was, 0) = 0").select(
        MATCH, TS, SEQ, "player_id", "team_id", "player_x", "player_y", "player_z",
        *[F.col(c).alias(f"ball_{c}") for c in "xyz"], "num_nearer", zone(F.col("areas")).alias("zone"),
    )
    kicks = asof_join(kicks, duels, [MATCH], {"__duel": F.col("phase")}, p.chunk_ms, crowded=False)
    kicks = asof_join(
        kicks, pressure.withColumn(SEQ, F.col("tick_ts")), [MATCH], {"__pressure": F.col("phase")}, p.chunk_ms, crowded=False
    )
    active = [F.coalesce(F.col(c) != "END", F.lit(False)) for c in ("__duel", "__pressure")]
    return done(kicks.withColumn("attacked", active[0] | active[1]))


def second_events(changes: DataFrame, areas: DataFrame, p: Params) -> DataFrame:
    """What can end a pass: receipts (kind 1), and entries of the ball into an outside area (kind 0)."""
    receipts = changes.filter("player_id is not null").select(
        MATCH, TS, SEQ, F.lit(1).alias("kind"), F.lit("").alias("area_id"),
        F.col("player_id").alias("receiver"), F.col("team_id").alias("receiver_team"),
        *[F.col(f"player_{c}").alias(f"end_{c}") for c in "xyz"],
        F.col("num_nearer").alias("receiver_nearer"), zone(F.col("areas")).alias("end_zone"),
    )
    entries = areas.filter((F.col("object_id") == p.ball) & F.col("in_area") & F.col("area_id").isin(*OUTSIDE_AREAS))
    entries = entries.select(
        MATCH, TS, SEQ, F.lit(0).alias("kind"), "area_id", *[F.col(c).alias(f"end_{c}") for c in "xyz"]
    )
    return receipts.unionByName(entries, allowMissingColumns=True)


SECOND_COLUMNS = [TS, SEQ, "kind", "area_id", "receiver", "receiver_team", "end_x", "end_y", "end_z", "receiver_nearer", "end_zone", "left_team"]


def matched_columns() -> list[Column]:
    """Columns of a matched kick, from those of its second event and the struct `kick`."""
    return [
        F.col(MATCH), F.col(TS), F.col(SEQ), F.col(f"kick.{TS}").alias("kick_ts"), *[F.col(c) for c in SECOND_COLUMNS[2:]],
        F.col("kick.player_id").alias("kicker"), F.col("kick.team_id").alias("kicker_team"),
        *[F.col(f"kick.player_{c}").alias(f"kick_{c}") for c in "xyz"],
        F.col("kick.num_nearer").alias("kicker_nearer"), F.col("kick.attacked").alias("attacked"),
        F.col("kick.zone").alias("kick_zone"),
    ]


def pass_shot_match(kicks: DataFrame, changes: DataFrame, areas: DataFrame, kickoffs: DataFrame, p: Params) -> DataFrame:
    """Each kick with the first receipt, or entry of the ball into an outside area, that follows in time.

    All streams are sparse here; one union and one scan give every second event the latest earlier kick
    and the playing sides, then the first second event of each kick is kept by a plain minimum.
    """
    second = second_events(changes, areas, p).withColumn("__rank", F.lit(1))
    kick_cols = [c for c in kicks.columns if c != MATCH]
    kick = kicks.select(MATCH, TS, SEQ, F.struct(*kick_cols).alias("__kick"), F.lit(2).alias("__rank"))
    sides = kickoffs.select(MATCH, TS, SEQ, F.col("left_team").alias("__side"), F.lit(0).alias("__rank"))
    both = second.unionByName(kick, allowMissingColumns=True).unionByName(sides, allowMissingColumns=True)
    found = scan(
        both, [MATCH], [TS, "__rank", SEQ], p.chunk_ms, Last("kick", F.col("__kick")), Last("left_team", F.col("__side"))
    ).filter(
        (F.col("__rank") == 1) & F.col("kick").isNotNull() & F.col("left_team").isNotNull()
        & (F.col(TS) > F.col(f"kick.{TS}")) & (F.col(TS) - F.col(f"kick.{TS}") <= p.pass_max_ms)
    )
    first = found.groupBy(MATCH, F.col(f"kick.{TS}").alias("kick_ts"), F.col(f"kick.{SEQ}").alias("kick_seq")).agg(
        F.min(F.struct(*SECOND_COLUMNS, "kick")).alias("__f")
    )
    return first.select(MATCH, "__f.*").select(*matched_columns())


def outcome(p: Params) -> Column:
    """One of the six outcomes of a matched kick; conditions are tried in order."""
    left = F.col("kicker_team") == F.col("left_team")
    pressed = F.col("attacked") & F.when(left, F.col("kick_zone") == "left").otherwise(F.col("kick_zone") == "right")
    relieved = (F.col("end_zone") == "center") | F.when(left, F.col("end_zone") == "right").otherwise(F.col("end_zone") == "left")
    area = F.col("area_id")
    own_side = F.when(left, area.contains("LeftGoal") | (area == "leftGoal")).otherwise(
        area.contains("RightGoal") | (area == "rightGoal")
    )
    received = F.when(F.col("kicker_team") == F.col("receiver_team"), "successful_pass").when(
        pressed & relieved, "clearance"
    ).otherwise("interception")
    return (
        F.when(F.col("kind") == 1, received)
        .when(area.isin(*GOALS) & (F.col("end_z") < p.goal_height), "goal")
        .when(pressed, "clearance")
        .when(area.isin(*GOALS, *BESIDE_GOALS) & ~own_side, "shot_off_target")
        .otherwise("misplaced_pass")
    )


def pass_geometry(matched: DataFrame, p: Params) -> DataFrame:
    """Length, velocity, angle in [0, 2 pi) relative to the playing direction, and direction class."""
    v = tuple(F.col(f"end_{c}") - F.col(f"kick_{c}") for c in "xyz")
    left = F.col("kicker_team") == F.col("left_team")
    ahead = (F.when(left, 1.0).otherwise(-1.0), F.lit(0.0), F.lit(0.0))
    turned = F.when(left, F.col("end_y") < F.col("kick_y")).otherwise(F.col("end_y") > F.col("kick_y"))
    a, t = F.col("angle"), p.sideways_angle
    direction = (
        F.when((a < t) | (a > 2 * math.pi - t), "FORWARD")
        .when((a >= t) & (a <= math.pi - t), "RIGHT")
        .when((a > math.pi - t) & (a < math.pi + t), "BACKWARD")
        .otherwise("LEFT")
    )
    out = matched.withColumn("length", norm3(*v)).withColumn(
        "velocity", F.col("length") / (F.col(TS) - F.col("kick_ts")) * 1000
    )
    raw = angle3(ahead, v)
    return out.withColumn("angle", F.when(turned, 2 * math.pi - raw).otherwise(raw)).withColumn("direction", direction)


def pass_events(matched: DataFrame, p: Params) -> DataFrame:
    """Matched kicks with outcome, geometry and, for successful passes, the opponents bypassed."""
    out = pass_geometry(matched, p).withColumn("outcome", outcome(p))
    return out.withColumn(
        "packing", F.when(F.col("outcome") == "successful_pass", F.col("kicker_nearer") - F.col("receiver_nearer"))
    )


def _rate(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def pass_statistics(passes: DataFrame, p: Params) -> DataFrame:
    """Running counts and rates of the kicker and the team after each pass outcome."""
    rows = item_rollup(passes.filter(F.col("outcome").isin(*PASSES)), "kicker", "kicker_team")
    count = lambda c: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    run = scan(
        rows, [MATCH, "item"], ORDER, p.chunk_ms,
        *[Total(o, count(F.col("outcome") == o)) for o in PASSES],
        *[Total(f"__{d}", count(F.col("direction") == d)) for d in DIRECTIONS],
        Total("__packing", F.coalesce(F.col("packing").cast("bigint"), F.lit(0).cast("bigint"))),
    )
    total = sum((F.col(o) for o in PASSES[1:]), F.col(PASSES[0]))
    return run.select(
        MATCH, TS, SEQ, "item", *PASSES, _rate(F.col("successful_pass"), total).alias("success_rate"),
        *[_rate(F.col(f"__{d}"), total).alias(f"{d.lower()}_rate") for d in DIRECTIONS],
        _rate(F.col("__packing"), F.col("successful_pass")).alias("avg_packing"),
    )


def shot_statistics(passes: DataFrame, p: Params) -> DataFrame:
    """Running goals and shots of the kicker and the team; shots on target are not detected and stay 0."""
    rows = item_rollup(passes.filter(F.col("outcome").isin(*SHOTS)), "kicker", "kicker_team")
    run = scan(
        rows, [MATCH, "item"], ORDER, p.chunk_ms,
        *[Total(n, (F.col("outcome") == o).cast("bigint")) for n, o in (("goals", "goal"), ("off_target", "shot_off_target"))],
    )
    return run.select(MATCH, TS, SEQ, "item", "goals", F.lit(0).cast("bigint").alias("on_target"), "off_target")


def pass_chains(passes: DataFrame, areas: DataFrame, p: Params) -> DataFrame:
    """Every successful pass with the chain of passes it ends: length, first time and pairs.

    A chain breaks when the team changes, the gap is too long, the receiver is not the next kicker, or
    the play was interrupted since the pass before. The chain is the part of the pass history (all of it,
    unless `pass_history` bounds it) back to the nearest break.
    """
    played = passes.filter("outcome = 'successful_pass'").select(
        MATCH, TS, SEQ, F.col("kicker_team").alias("team_id"), "kicker", "receiver", F.lit(1).alias("__rank")
    )
    broken = passes.filter(F.col("outcome").isin("interception", "misplaced_pass", "clearance")).select(MATCH, TS, SEQ)
    left = areas.filter((F.col("object_id") == p.ball) & (F.col("area_id") == "field") & ~F.col("in_area"))
    stops = broken.unionByName(left.select(MATCH, TS, SEQ)).withColumn("__rank", F.lit(0))
    both = played.unionByName(stops, allowMissingColumns=True)
    run = scan(
        both, [MATCH], [TS, "__rank", SEQ], p.chunk_ms,
        High("__stop", F.when(F.col("__rank") == 0, F.col(TS))),
        Last("__last", F.when(F.col("__rank") == 1, F.struct(TS, "team_id", "receiver")), inclusive=False),
    ).filter("__rank = 1")
    goes_on = (
        (F.col("__last.team_id") == F.col("team_id"))
        & (F.col(TS) - F.col(f"__last.{TS}") <= p.pass_gap_ms)
        & (F.col("__last.receiver") == F.col("kicker"))
        & (F.coalesce("__stop", F.col(f"__last.{TS}")) <= F.col(f"__last.{TS}"))
    )
    run = run.withColumn("__break", ~F.coalesce(goes_on, F.lit(False)))
    one = F.struct(F.col("__break").alias("b"), "kicker", "receiver", TS)
    if p.pass_history is None:  # passes since a break are an island of their own
        run = scan(run, [MATCH], [TS, "__rank", SEQ], p.chunk_ms, Total("__island", F.col("__break").cast("bigint")))
        island = Window.partitionBy(MATCH, "__island").orderBy(TS, "__rank", SEQ).rowsBetween(Window.unboundedPreceding, 0)
        run = run.withColumn("__chain", F.collect_list(one).over(island)).withColumn("length", F.size("__chain"))
    else:
        run = scan(run, [MATCH], [TS, "__rank", SEQ], p.chunk_ms, History("__h", one, p.pass_history))
        first = F.array_position(F.transform("__h", lambda e: e["b"]), True)
        length = F.when(first == 0, F.size("__h")).otherwise(first).cast("int")
        run = run.withColumn("length", length).withColumn("__chain", F.reverse(F.slice("__h", 1, F.col("length"))))
    return run.select(
        MATCH, TS, SEQ, "team_id", F.col("length").cast("bigint").alias("length"),
        F.get("__chain", F.lit(0))[TS].alias("first_ts"),
        F.transform("__chain", lambda e: F.struct(e["kicker"].alias("kicker"), e["receiver"].alias("receiver"))).alias("chain"),
    )


def pass_sequence(chains: DataFrame) -> DataFrame:
    return chains.filter("length >= 2")


def double_pass(chains: DataFrame) -> DataFrame:
    """Two passes that return to the first kicker."""
    return chains.filter((F.col("length") == 2) & (F.col("chain")[0]["kicker"] == F.col("chain")[1]["receiver"]))


def chain_text(chain: Column) -> Column:
    return F.array_join(F.transform(chain, lambda e: F.concat(e["kicker"], F.lit(">"), e["receiver"])), ";")


def pass_sequence_statistics(chains: DataFrame, p: Params) -> DataFrame:
    """Per participant: sequences, average and longest length, double passes.

    The first time an item meets a sequence counts its current length, every later pass of it one more.
    """
    seq = pass_sequence(chains).withColumn(
        "__double", ((F.col("length") == 2) & (F.col("chain")[0]["kicker"] == F.element_at("chain", -1)["receiver"])).cast("bigint")
    )
    people = F.concat(
        F.array("team_id"), F.transform("chain", lambda e: e["kicker"]), F.transform("chain", lambda e: e["receiver"])
    )
    rows = seq.withColumn("item", F.explode(F.array_distinct(people)))
    met = scan(rows, [MATCH, "item"], ORDER, p.chunk_ms, High("__seen", F.col("first_ts"), inclusive=False))
    fresh = F.col("__seen").isNull() | (F.col("first_ts") > F.col("__seen"))
    met = met.withColumn("__new", fresh.cast("bigint"))
    run = scan(
        met, [MATCH, "item"], ORDER, p.chunk_ms,
        Total("num", F.col("__new")),
        Total("__sum", F.when(F.col("__new") == 1, F.col("length")).otherwise(1)),
        High("max_length", F.col("length")),
        Total("num_double", F.col("__double")),
    )
    return run.select(MATCH, TS, SEQ, "item", "num", (F.col("__sum") / F.col("num")).alias("avg_length"), "max_length", "num_double")
