"""Kickoffs, match time, ball hits, ball possession and duels: everything decided on ball rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.functions.geometry import (
    angle3, attacked_goal, distance, k_nearest, minus, nearest, norm3, players_nearer_to_goal,
)
from tracklane.operators.asof import MATCH, ORDER, SEQ, TS, asof_join, snapshot_asof
from tracklane.operators.keyed import active_key_ticks, phase_events
from tracklane.operators.ordered import High, History, Last, Low, Total, done, scan
from tracklane.operators.stateful import debounce
from tracklane.params import Params


def point(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in "xyz"])


def ball_frames(states: DataFrame, p: Params) -> DataFrame:
    """Ball rows with the latest position of every player (null until all were seen)."""
    frames = snapshot_asof(
        states, p.roster, ["x", "y", "z"], p.chunk_ms,
        trigger=F.col("object_id") == p.ball, name="players", complete=False,
    )
    return frames.select(MATCH, TS, SEQ, "x", "y", "z", "vabs", "areas", "field_length", "players")


def kickoff_event(frames: DataFrame, p: Params) -> DataFrame:
    """Ball near the midpoint, one team in the circle, each half of one team; the nearest one kicks."""
    middle = F.struct(*[F.lit(0.0).alias(c) for c in "xyz"])
    ball = point()
    near = frames.filter(F.col("players").isNotNull() & (norm3(F.col("x"), F.col("y"), F.col("z")) <= p.kickoff_ball_dist))
    in_circle = lambda o: distance(o, middle) < p.kickoff_player_dist
    teams = lambda cond: F.array_distinct(F.transform(F.filter("players", cond), lambda o: o["team_id"]))
    side = near.select(
        "*",
        nearest(F.filter("players", in_circle), ball, flat=False).alias("__k"),
        teams(in_circle).alias("__circle"),
        teams(lambda o: ~in_circle(o) & (o["x"] < -p.kickoff_midline_dist)).alias("__left"),
        teams(lambda o: ~in_circle(o) & (o["x"] > p.kickoff_midline_dist)).alias("__right"),
    )
    found = side.filter((F.size("__circle") == 1) & (F.size("__left") == 1) & (F.size("__right") <= 1))
    a, b = p.teams
    kicker, other = F.col("__k.team_id"), F.when(F.col("__k.team_id") == a, b).otherwise(a)
    kicks_left = F.col("__left")[0] == kicker
    candidates = found.select(
        MATCH, TS, SEQ, F.col("__k.object_id").alias("player_id"), kicker.alias("team_id"),
        *[F.col(c).alias(f"ball_{c}") for c in "xyz"],
        F.when(kicks_left, kicker).otherwise(other).alias("left_team"),
        F.when(kicks_left, other).otherwise(kicker).alias("right_team"),
    )
    return debounce(candidates, [MATCH], p.kickoff_gap_ms, p.chunk_ms)


def match_time_progress(frames: DataFrame, kickoffs: DataFrame, p: Params) -> DataFrame:
    """Whole seconds since the oldest remembered kickoff, whenever they grow."""
    if p.kickoff_history is None:
        oldest = done(scan(kickoffs, [MATCH], ORDER, p.chunk_ms, Low("oldest", F.col(TS))))
    else:
        oldest = scan(kickoffs, [MATCH], ORDER, p.chunk_ms, History("__h", F.col(TS), p.kickoff_history))
        oldest = done(oldest.withColumn("oldest", F.element_at("__h", -1)))
    timed = asof_join(frames.select(MATCH, TS, SEQ), oldest, [MATCH], {"oldest": F.col("oldest")}, p.chunk_ms, crowded=False)
    timed = timed.filter(F.col("oldest").isNotNull()).withColumn(
        "time_in_s", F.floor((F.col(TS) - F.col("oldest")) / F.lit(1000))
    )
    grown = scan(timed, [MATCH], ORDER, p.chunk_ms, High("__m", F.col("time_in_s"), inclusive=False))
    return grown.filter(F.col("__m").isNull() | (F.col("time_in_s") > F.col("__m"))).select(MATCH, TS, SEQ, "time_in_s")


def hit_kind(history: Column, p: Params) -> Column:
    """'velocity' or 'direction' if the ball was hit; `history` holds its last three states, newest first."""
    h = [F.get(history, F.lit(i)) for i in range(3)]
    jump = (h[0]["vabs"] < p.hit_max_speed) & (F.abs(h[1]["vabs"] - h[0]["vabs"]) > p.hit_speed_diff)
    turn = angle3(minus(h[2], h[1]), minus(h[1], h[0])) > p.hit_angle
    return F.when(jump, "velocity").when(turn, "direction")


def possession_frames(frames: DataFrame, kickoffs: DataFrame, p: Params) -> DataFrame:
    """Ball rows with hit, holder before and after the row, and what kicks and duels need of the holder.

    A row marks the possession: outside the field nobody has the ball, a hit inside gives it to the
    nearest player in reach, any other row keeps it.
    """
    team = kickoffs.select(MATCH, TS, SEQ, F.col("left_team").alias("__left"), F.lit(0).alias("__rank"))
    both = frames.withColumn("__rank", F.lit(1)).unionByName(team, allowMissingColumns=True)
    past = scan(
        both, [MATCH], [TS, "__rank", SEQ], p.chunk_ms,
        History("__h", F.when(F.col("__rank") == 1, F.struct("x", "y", "z", "vabs")), 3),
        Last("left_team", F.col("__left")),
    ).filter("__rank = 1")
    in_field = F.array_contains("areas", "field")
    ready = F.col("players").isNotNull() & (~in_field | (F.size("__h") >= 2))
    near = nearest(F.col("players"), point(), p.possession_dist)
    rows = past.select("*", ready.alias("ready"), in_field.alias("in_field"), hit_kind(F.col("__h"), p).alias("hit"))
    taker = F.when(F.col("in_field") & F.col("hit").isNotNull(), near)
    holder_type = "struct<player_id:string,team_id:string>"
    marker = F.when(
        F.col("ready") & ~F.col("in_field"), F.struct(F.lit(None).cast("string").alias("player_id"), F.lit(None).cast("string").alias("team_id"))
    ).when(F.col("ready") & taker.isNotNull(), F.struct(taker["object_id"].alias("player_id"), taker["team_id"].alias("team_id")))
    rows = rows.withColumn("__marker", marker.cast(holder_type))
    known = scan(
        rows, [MATCH], [TS, "__rank", SEQ], p.chunk_ms,
        Last("holder", F.col("__marker")), Last("__before", F.col("__marker"), inclusive=False),
    )
    me = F.get(F.filter("players", lambda o: o["object_id"] == F.col("holder.player_id")), F.lit(0))
    known = known.withColumn("__me", me)
    goal = attacked_goal(F.col("holder.team_id"), F.col("left_team"), F.col("field_length"))
    two = k_nearest(F.col("players"), point(), 2, p.duel_dist)
    first, second = F.get("__two", F.lit(0)), F.get("__two", F.lit(1))
    mine = [o["object_id"] == F.col("holder.player_id") for o in (first, second)]
    duel = F.when(
        F.col("ready") & F.col("in_field") & (F.size("__two") == 2) & (first["team_id"] != second["team_id"]),
        F.when(mine[0], F.struct(first["object_id"].alias("defending"), second["object_id"].alias("attacking")))
        .when(mine[1], F.struct(second["object_id"].alias("defending"), first["object_id"].alias("attacking"))),
    )
    return known.withColumn("__two", two).select(
        MATCH, TS, SEQ, "x", "y", "z", "vabs", "areas", "left_team", "ready", "in_field", "hit",
        F.col("holder.player_id").alias("player_id"), F.col("holder.team_id").alias("team_id"),
        (F.col("__marker").isNotNull() & ~F.col("__marker.player_id").eqNullSafe(F.col("__before.player_id"))).alias("changed"),
        *[F.col(f"__me.{c}").alias(f"player_{c}") for c in "xyz"],
        distance(F.col("__me"), point()).alias("holder_dist"),
        F.when(F.col("__me").isNotNull(), players_nearer_to_goal(F.col("players"), F.col("__me"), F.col("holder.team_id"), goal)).alias("num_nearer"),
        duel.alias("duel"),
    )


def ball_hit(possession: DataFrame) -> DataFrame:
    return possession.filter("hit is not null").select(MATCH, TS, SEQ, "hit")


def ball_possession_change(possession: DataFrame) -> DataFrame:
    """Rows where the holder changes; player null means nobody."""
    return possession.filter("changed").select(
        MATCH, TS, SEQ, "player_id", "team_id", "player_x", "player_y", "player_z",
        *[F.col(c).alias(f"ball_{c}") for c in "xyz"], F.coalesce("num_nearer", F.lit(0)).alias("num_nearer"),
        "left_team", "areas",
    )


def duel_event(possession: DataFrame, p: Params) -> DataFrame:
    """Holder and an opponent are the two nearest to the ball."""
    rows = phase_events(possession.filter("ready"), [MATCH], ORDER, p.chunk_ms, F.col("duel"), [])
    return rows.select(MATCH, TS, SEQ, "identity.defending", "identity.attacking", "phase", "event_no")


def possession_state(rows: DataFrame, changes: DataFrame, p: Params) -> DataFrame:
    """Each row with the holder at its time; no player means nobody has the ball."""
    held = asof_join(
        rows, changes, [MATCH], {"holder_player": F.col("player_id"), "holder_team": F.col("team_id")}, p.chunk_ms, crowded=False
    )
    return held.withColumn("someone", F.col("holder_player").isNotNull())


def item_totals(rows: DataFrame, order: list[str], p: Params, amount, name: str) -> DataFrame:
    """Running totals of every statistics item side by side, then one row per item.

    `amount(item)` is the item's increase at a row; the totals of all items share one pass.
    """
    items = p.items
    run = scan(rows, [MATCH], order, p.chunk_ms, *[Total(f"__i{n}", amount(i)) for n, i in enumerate(items)])
    pairs = F.array(*[F.struct(F.lit(i).alias("item"), F.col(f"__i{n}").alias(name)) for n, i in enumerate(items)])
    teams = [F.col(f"__i{n}") for n, i in enumerate(items) if i in p.teams]
    return run.withColumn("__team_total", sum(teams[1:], teams[0])).withColumn("__e", F.explode(pairs)).select(
        *rows.columns, "__e.*", F.col("__team_total").alias("team_total")
    )


def ball_possession_statistics(states: DataFrame, changes: DataFrame, p: Params) -> DataFrame:
    """One second per tick for the holder and the team, and the share of the time of both teams."""
    ticks = active_key_ticks(states, MATCH, p.possession_tick_ms, p.active_threshold_ms, p.chunk_ms)
    ball = states.filter(F.col("object_id") == p.ball).groupBy(MATCH).agg(F.min(TS).alias("__first"))
    ticks = ticks.join(ball, MATCH).filter("tick_ts >= __first").select(
        MATCH, F.col("tick_ts").alias(TS), F.col("tick_ts").alias(SEQ), "max_generation_ts"
    )
    held = possession_state(ticks, changes, p)

    def one(item: str) -> Column:
        return ((F.col("holder_player") == item) | (F.col("holder_team") == item)).cast("bigint")

    rows = item_totals(held, ORDER, p, lambda i: F.coalesce(one(i), F.lit(0).cast("bigint")), "time_s")
    share = F.when(F.col("team_total") == 0, 0.0).otherwise(F.col("time_s") / F.col("team_total"))
    return rows.select(MATCH, F.col(TS).alias("tick_ts"), F.col("max_generation_ts").alias(TS), "item", "time_s", share.alias("percentage"))
