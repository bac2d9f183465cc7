"""Pressing on the player who has the ball."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.functions.geometry import norm3, projected_norm3
from tracklane.operators.asof import MATCH, SEQ, TS, snapshot_asof
from tracklane.operators.keyed import active_key_ticks, phase_events
from tracklane.params import Params
from tracklane.session import materialize

FIELDS = ["x", "y", "z", "vx", "vy", "vz"]


def index(objects: Column, team: Column) -> Column:
    """Sum over the opponents of the speed at which they and the ball close in, per metre between them.

    The ball is the first of the objects.
    """
    ball = F.get(objects, F.lit(0))

    def one(o):
        to_player = tuple(o[c] - ball[c] for c in "xyz")
        to_ball = tuple(ball[c] - o[c] for c in "xyz")
        closing = projected_norm3(tuple(o[f"v{c}"] for c in "xyz"), to_ball) + projected_norm3(
            tuple(ball[f"v{c}"] for c in "xyz"), to_player
        )
        gap = norm3(*to_player)
        return F.when(gap > 0, F.greatest(F.lit(0.0), closing / gap)).otherwise(0.0)

    opponents = F.filter(F.slice(objects, F.lit(2), F.size(objects)), lambda o: o["team_id"] != team)
    return F.when(team.isNull(), 0.0).otherwise(F.aggregate(opponents, F.lit(0.0), lambda acc, o: acc + one(o)))


def everybody(p: Params) -> tuple[tuple[str, str], ...]:
    """The ball, then the players."""
    return ((p.ball, p.ball),) + p.roster


def _holder(changes: DataFrame):
    return {"holder": (changes, F.struct("player_id", "team_id"))}


def pressing_index(states: DataFrame, changes: DataFrame, p: Params) -> DataFrame:
    """The index at every ball row."""
    snap = snapshot_asof(
        states.select(MATCH, TS, SEQ, "object_id", *FIELDS), everybody(p), FIELDS, p.chunk_ms,
        trigger=F.col("object_id") == p.ball, others=_holder(changes),
    )
    return snap.select(
        MATCH, TS, SEQ, "holder.player_id", index(F.col("objects"), F.col("holder.team_id")).alias("pressing_index")
    )


def pressing_state(states: DataFrame, changes: DataFrame, p: Params) -> DataFrame:
    """The index at every pressing tick; snapshots are taken at ticks only, not at every reading."""
    ticks = active_key_ticks(states, MATCH, p.pressing_tick_ms, p.active_threshold_ms, p.chunk_ms).select(
        MATCH, F.col("tick_ts").alias(TS), F.col("tick_ts").alias(SEQ), "max_generation_ts"
    )
    snap = snapshot_asof(
        states, everybody(p), FIELDS, p.chunk_ms, triggers=materialize(ticks, "ticks"), others=_holder(changes)
    )
    return snap.select(
        MATCH, F.col(TS).alias("tick_ts"), F.col("max_generation_ts").alias(TS), "holder.player_id",
        index(F.col("objects"), F.col("holder.team_id")).alias("pressing_index"),
    )


def under_pressure(pressing: DataFrame, p: Params) -> DataFrame:
    """The holder is under pressure while the index stays high."""
    who = F.when(F.col("pressing_index") >= p.pressing_min, F.col("player_id"))
    rows = phase_events(pressing, [MATCH], ["tick_ts"], p.chunk_ms, who, [TS, "pressing_index"])
    return rows.select(MATCH, "tick_ts", TS, F.col("identity").alias("player_id"), "pressing_index", "phase", "event_no")
