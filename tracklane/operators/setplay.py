"""Set plays: goal kicks, penalties, corners, free kicks and throw-ins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.functions.geometry import nearest
from tracklane.operators.asof import MATCH, ORDER, SEQ, TS
from tracklane.operators.keyed import item_rollup
from tracklane.operators.ordered import History, Last, Total, scan
from tracklane.operators.possession import point
from tracklane.operators.stateful import debounce
from tracklane.params import CORNERS, Params

KINDS = ("freekick", "cornerkick", "goalkick", "penalty", "throwin")


def set_play(frames: DataFrame, areas: DataFrame, kickoffs: DataFrame, p: Params) -> DataFrame:
    """A static ball starts moving near a player, or the ball just came back into the field."""
    n = p.set_play_history
    entered = areas.filter((F.col("object_id") == p.ball) & (F.col("area_id") == "field")).select(
        MATCH, TS, SEQ, F.col(TS).alias("__entered"), F.lit(0).alias("__rank")
    )
    sides = kickoffs.select(MATCH, TS, SEQ, F.col("left_team").alias("__side"), F.lit(0).alias("__rank"))
    both = (
        frames.withColumn("__rank", F.lit(1))
        .unionByName(entered, allowMissingColumns=True)
        .unionByName(sides, allowMissingColumns=True)
    )
    rows = scan(
        both, [MATCH], [TS, "__rank", SEQ], p.chunk_ms,
        History("__h", F.when(F.col("__rank") == 1, F.col("vabs")), n),
        Last("__field_ts", F.col("__entered")), Last("left_team", F.col("__side")),
    ).filter((F.col("__rank") == 1) & (F.size("__h") == n) & F.col("players").isNotNull())
    rows = rows.withColumn("__near", nearest(F.col("players"), point(), p.set_play_dist)).filter("__near is not null")
    still = F.forall(F.slice("__h", 2, n - 1), lambda v: v <= p.set_play_static) & (F.col("__h")[0] >= p.set_play_moving)
    inside = lambda a: F.array_contains("areas", a)
    left_side = F.coalesce(F.col("__near.team_id") == F.col("left_team"), F.lit(False))
    standing = (
        F.when(inside("leftPenaltyBox"), F.when(left_side, "goalkick").otherwise("penalty"))
        .when(inside("rightPenaltyBox"), F.when(left_side, "penalty").otherwise("goalkick"))
        .when(reduce(lambda a, b: a | b, [inside(c) for c in CORNERS]), "cornerkick")
        .when(inside("field"), "freekick")
    )
    back = F.when(inside("field") & (F.col(TS) - F.col("__field_ts") < p.throw_in_ms), "throwin")
    found = rows.withColumn("kind", F.when(still, standing).otherwise(back)).filter("kind is not null").select(
        MATCH, TS, SEQ, "kind", F.col("__near.object_id").alias("player_id"), F.col("__near.team_id").alias("team_id"),
        *[F.col(c).alias(f"ball_{c}") for c in "xyz"],
    )
    return debounce(found, [MATCH], p.set_play_gap_ms, p.chunk_ms)


def set_play_statistics(plays: DataFrame, p: Params) -> DataFrame:
    """Running counts of the five kinds for the player and the team."""
    run = scan(
        item_rollup(plays, "player_id", "team_id"), [MATCH, "item"], ORDER, p.chunk_ms,
        *[Total(k, (F.col("kind") == k).cast("bigint")) for k in KINDS],
    )
    return run.select(MATCH, TS, SEQ, "item", *KINDS)
