"""Offside line at the readings of the player who has the ball."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.operators.asof import MATCH, ORDER, SEQ, TS, slot_specs, slots, slots_complete
from tracklane.operators.ordered import Last, Prev, scan
from tracklane.operators.speed import players
from tracklane.params import Params


def offside_line(states: DataFrame, changes: DataFrame, kickoffs: DataFrame, p: Params) -> DataFrame:
    """The further of the holder and the second-last opponent in playing direction; null while nobody has it.

    Possession, playing sides and all player positions come from one pass over the union of the streams.
    Opponents at the same x count once.
    """
    rows = players(states, p).select(MATCH, TS, SEQ, "object_id", "team_id", "x", F.lit(1).alias("__rank"))
    held = changes.select(MATCH, TS, SEQ, F.struct("player_id", "team_id").alias("__holder"), F.lit(0).alias("__rank"))
    sides = kickoffs.select(MATCH, TS, SEQ, F.col("left_team").alias("__side"), F.lit(0).alias("__rank"))
    both = rows.unionByName(held, allowMissingColumns=True).unionByName(sides, allowMissingColumns=True)
    run = scan(
        both, [MATCH], [TS, "__rank", SEQ], p.chunk_ms,
        *slot_specs(p.roster, ["x"]), Last("__h", F.col("__holder")), Last("left_team", F.col("__side")),
    ).filter("__rank = 1")
    nobody = F.col("__h.player_id").isNull()
    counts = (F.col("__h.player_id") == F.col("object_id")) & slots_complete(p.roster) & F.col("left_team").isNotNull()
    rows = run.filter(nobody | counts).select(
        MATCH, TS, SEQ, "object_id", "team_id", "x", "left_team", nobody.alias("nobody"), slots(p.roster, ["x"]).alias("__all")
    )
    rows = scan(rows, [MATCH], ORDER, p.chunk_ms, Prev("__p", F.col("nobody")))
    rows = rows.filter(~F.col("nobody") | ~F.coalesce("__p", F.lit(False)))
    right = F.col("team_id") == F.col("left_team")
    ahead = F.when(right, 1.0).otherwise(-1.0)
    xs = F.transform(F.filter("__all", lambda o: o["team_id"] != F.col("team_id")), lambda o: o["x"] * ahead)
    if p.quirks:  # the smallest positive double served as "smallest number" when playing right
        xs = F.filter(xs, lambda x: ~right | (x > 5e-324))
    second = F.get(F.sort_array(F.array_distinct(xs), asc=False), F.lit(1))
    line = F.greatest(F.col("x") * ahead, second)
    rows = rows.withColumn("__line", line)
    beyond = F.filter("__all", lambda o: (o["team_id"] == F.col("team_id")) & (o["x"] * ahead > F.col("__line")))
    shown = ~F.col("nobody")
    return rows.select(
        MATCH, TS, SEQ, F.when(shown, F.col("object_id")).alias("player_id"),
        F.when(shown, F.col("__line") * ahead).alias("offside_x"),
        F.when(shown, F.transform(beyond, lambda o: o["object_id"])).alias("players_in_offside"),
    )
