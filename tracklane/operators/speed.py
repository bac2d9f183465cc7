"""Speed levels, dribblings and distances of players."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.functions.geometry import distance
from tracklane.operators.asof import MATCH, ORDER, SEQ, TS, asof_join, snapshot_asof
from tracklane.operators.keyed import active_key_ticks, emit_on_change, item_rollup
from tracklane.operators.ordered import Prev, Total, scan
from tracklane.operators.stateful import chunked_scan
from tracklane.params import Params
from tracklane.session import materialize


def players(states: DataFrame, p: Params) -> DataFrame:
    return states.filter(F.col("object_id") != p.ball)


def speed_level(v: Column, p: Params) -> Column:
    """Number of thresholds at or below the speed."""
    level = F.lit(0)
    for i, t in enumerate(p.speed_levels):
        level = F.when(v >= t, i + 1).otherwise(level)
    return level


def speed_level_change(states: DataFrame, p: Params) -> DataFrame:
    """A player's first row, and every row with another level than the row before."""
    rows = players(states, p).select(
        MATCH, TS, SEQ, "object_id", "team_id", speed_level(F.col("vabs"), p).alias("speed_level")
    )
    return emit_on_change(rows, [MATCH, "object_id"], ORDER, p.chunk_ms, F.col("speed_level"))


def speed_level_statistics(changes: DataFrame, p: Params) -> DataFrame:
    """Time is booked to a level when it is left, for the player and the team."""
    left = scan(changes, [MATCH, "object_id"], ORDER, p.chunk_ms, Prev("__p", F.struct(TS, "speed_level")))
    spent = left.withColumn("__ms", F.col(TS) - F.col(f"__p.{TS}")).filter("__ms > 0")
    spent = spent.select(MATCH, TS, SEQ, "object_id", "team_id", "__ms", F.col("__p.speed_level").alias("__level"))
    levels = range(len(p.speed_levels) + 1)
    zero = F.lit(0).cast("bigint")
    run = scan(
        item_rollup(spent, "object_id", "team_id"), [MATCH, "item"], ORDER, p.chunk_ms,
        *[Total(f"__t{n}", F.when(F.col("__level") == n, F.col("__ms")).otherwise(zero)) for n in levels],
    )
    times = F.array(*[F.col(f"__t{n}") for n in levels])
    total = sum((F.col(f"__t{n}") for n in levels[1:]), F.col("__t0"))
    return run.select(
        MATCH, TS, SEQ, "item",
        F.transform(times, lambda t: F.floor(t / 1000)).alias("times_s"),
        F.transform(times, lambda t: F.when(t == 0, 0.0).otherwise(t / total)).alias("percentages"),
    )


DRIBBLING = T.StructType([
    T.StructField(MATCH, T.StringType()), T.StructField(TS, T.LongType()), T.StructField(SEQ, T.LongType()),
    T.StructField("player_id", T.StringType()), T.StructField("team_id", T.StringType()),
    T.StructField("phase", T.StringType()), T.StructField("duration", T.LongType()),
    T.StructField("length", T.DoubleType()),
])


def _dribble(p: Params):
    """Rules of one match's holder rows; the state is [dribbler, start, length, position, waiter, since]."""

    def step(pdf: pd.DataFrame, state):
        who, start, length, at, waiter, since = state or [None, None, 0.0, None, None, None]
        out = []

        def emit(r, phase):
            out.append((r[0], r[1], r[2], r[3], r[4], phase, 0 if phase == "START" else r[1] - start, length))

        cols = [MATCH, TS, SEQ, "object_id", "team_id", "holder_player", "vabs", "x", "y", "z"]
        for r in zip(*[pdf[c].tolist() for c in cols]):
            ts, player, holder, fast, here = r[1], r[3], r[5], r[6] >= p.dribble_speed, list(r[7:10])
            mine = player == holder
            if who is not None and who != holder:
                if player == who:
                    length += math.dist(at, here)
                    emit(r, "END")
                    who, start, length, at = None, None, 0.0, None
            elif mine and fast and who is not None:
                length += math.dist(at, here)
                emit(r, "ACTIVE")
                at = here
            elif mine and fast and waiter is None:
                waiter, since = player, ts
            elif mine and fast and waiter == player:
                if ts - since > p.dribble_ms:
                    who, start, length, at, waiter, since = player, ts, 0.0, here, None, None
                    emit(r, "START")
            elif mine and fast:
                waiter, since = None, None
            elif mine and who is not None:
                length += math.dist(at, here)
                emit(r, "END")
                who, start, length, at = None, None, 0.0, None
            elif mine:
                waiter, since = None, None
        names = DRIBBLING.fieldNames()
        return pd.DataFrame(out, columns=names), [who, start, length, at, waiter, since]

    return step


def _dribble_chunk(p: Params):
    """A chunk of holder rows as a function of the state before it, which is one of three: nobody, a waiter since some time,
    or a dribbler with start, length and position.

    - From nobody it leaves one state.
    - A waiter matters only if the chunk's first row of a holder is the waiter's and fast; then the dribbling starts at the first
      of the waiter's rows that is late enough, which is at most one row after the waiting time from the first. For each such
      row the description has the state that follows, and one for none of them.
    - A dribbler without a row in the chunk stays. Of others it has the state after their dribbling has ended or, if it goes
      on, the first and last position and the length between.
    """
    step = _dribble(p)
    no_one = [None, None, 0.0, None, None, None]

    def run(pdf: pd.DataFrame, state: list) -> list:
        return step(pdf, list(state))[1]

    def describe(pdf: pd.DataFrame) -> dict:
        own = pdf[pdf["object_id"] == pdf["holder_player"]]
        said = {"idle": run(pdf, no_one), "first": None, "who": {}}
        if len(own):
            first = own["object_id"].iloc[0]
            said["other"] = run(pdf, [*no_one[:4], "", 0])  # a waiter that has no row here: ids are not empty
            rows = own[(own["object_id"] != first) | ~(own["vabs"] >= p.dribble_speed)]
            run_rows = own if rows.empty else own.loc[:rows.index[0]].iloc[:-1]
            times = run_rows[TS].tolist()
            said["first"] = first
            starts = [t for t in dict.fromkeys(times)]
            enough = next((i for i, t in enumerate(starts) if t > starts[0] + p.dribble_ms), len(starts) - 1) if starts else -1
            said["starts"] = [[t, run(pdf, [*no_one[:4], first, t - p.dribble_ms - 1])] for t in starts[:enough + 1]]
            # none of these is late enough: the waiting ends with the run, or goes on
            said["stay"] = run(pdf, [*no_one[:4], first, times[-1]]) if times else said["other"]
            said["waits"] = bool(times) and said["stay"][0] is None and said["stay"][4:] == [first, times[-1]] and rows.empty
        for who, mine in pdf.groupby("object_id", sort=False):
            here = mine[["x", "y", "z"]].iloc[0].tolist()
            left = run(pdf, [who, -1, 0.0, here, None, None])
            goes_on = left[0] == who and left[1] == -1
            said["who"][who] = [None, here, left[2], left[3]] if goes_on else [left]
        return said

    def follow(state: list | None, said: dict) -> list:
        who, start, length, at, waiter, since = state or no_one
        if who is not None:
            then = said["who"].get(who)
            if then is None:
                return state
            if then[0] is not None:
                return then[0]
            return [who, start, length + math.dist(at, then[1]) + then[2], then[3], None, None]
        if waiter is None:
            return said["idle"]
        if said["first"] is None:
            return state
        if said["first"] != waiter:
            return said["other"]
        late = next((s for t, s in said["starts"] if t - since > p.dribble_ms), None)
        return late or ([*no_one[:4], waiter, since] if said["waits"] else said["stay"])

    return describe, follow


def dribbling_event(states: DataFrame, changes: DataFrame, p: Params) -> DataFrame:
    """START after the holder was fast for long enough, ACTIVE while fast, END when slow or the ball is lost.

    Only the holder's own rows and a former holder's first row afterwards can matter, so all other rows
    are left out before the sequential rule runs.
    """
    rows = players(states, p).select(MATCH, TS, SEQ, "object_id", "team_id", "x", "y", "z", "vabs")
    held = asof_join(rows, changes, [MATCH], {"holder_player": F.col("player_id")}, p.chunk_ms, crowded=False)
    mine = F.coalesce(F.col("holder_player") == F.col("object_id"), F.lit(False))
    held = scan(held, [MATCH, "object_id"], ORDER, p.chunk_ms, Prev("__was", mine))
    sparse = held.filter(mine | F.coalesce("__was", F.lit(False))).drop("__was", "__chunk")
    rows = chunked_scan(sparse, [MATCH], ORDER, p.chunk_ms, _dribble(p), *_dribble_chunk(p), schema=DRIBBLING, max_rows=20_000)
    numbered = scan(rows, [MATCH], ORDER, p.chunk_ms, Total("event_no", (F.col("phase") == "START").cast("bigint")))
    velocity = F.when(F.col("phase") == "START", 0.0).when(F.col("duration") > 0, F.col("length") / F.col("duration") * 1000)
    return numbered.select(*DRIBBLING.fieldNames(), velocity.alias("velocity"), "event_no")


def dribbling_statistics(events: DataFrame, p: Params) -> DataFrame:
    """Number, average duration (s) and average length of the ended dribblings per player and team."""
    ended = item_rollup(events.filter("phase = 'END'"), "player_id", "team_id")
    run = scan(
        ended, [MATCH, "item"], ORDER, p.chunk_ms,
        Total("num", F.lit(1).cast("bigint")), Total("__d", F.col("duration")), Total("__l", F.col("length")),
    )
    return run.select(
        MATCH, TS, SEQ, "item", "num", (F.col("__d") / F.col("num") / 1000).alias("avg_duration_s"),
        (F.col("__l") / F.col("num")).alias("avg_length"),
    )


def distance_statistics(states: DataFrame, p: Params) -> DataFrame:
    """At every tick, the way each player and team covered, measured between ticks."""
    moving = players(states, p)
    ticks = active_key_ticks(moving, MATCH, p.distance_tick_ms, p.active_threshold_ms, p.chunk_ms).select(
        MATCH, F.col("tick_ts").alias(TS), F.col("tick_ts").alias(SEQ), "max_generation_ts"
    )
    snap = snapshot_asof(moving, p.roster, ["x", "y", "z"], p.chunk_ms, triggers=materialize(ticks, "ticks"))
    each = snap.select(MATCH, TS, SEQ, "max_generation_ts", F.explode("objects").alias("o"))
    each = each.select(MATCH, TS, SEQ, "max_generation_ts", F.col("o.object_id").alias("player"), F.col("o.team_id").alias("team"), "o")
    each = materialize(each, "tick-positions")
    each = scan(each, [MATCH, "player"], ORDER, p.chunk_ms, Prev("__p", F.col("o")))
    way = each.withColumn("__d", F.coalesce(distance(F.col("o"), F.col("__p")), F.lit(0.0)))
    way = item_rollup(way, "player", "team").groupBy(MATCH, TS, SEQ, "max_generation_ts", "item").agg(F.sum("__d").alias("__d"))
    rows = scan(way, [MATCH, "item"], ORDER, p.chunk_ms, Total("distance", F.col("__d")))
    return rows.select(MATCH, F.col(TS).alias("tick_ts"), F.col("max_generation_ts").alias(TS), "item", "distance")
