"""From raw position readings to object states and area events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.functions.geometry import norm3
from tracklane.functions.parsing import areas_at, parse_areas, rename_map, renamed
from tracklane.operators.asof import MATCH, ORDER, TS, SEQ, asof_join
from tracklane.operators.ordered import Prev, done, scan
from tracklane.params import Params
from tracklane.session import materialize

STATE = [MATCH, TS, SEQ, "object_id", "team_id", "x", "y", "z", "vx", "vy", "vz", "vabs"]


def field_object_state(raw: DataFrame, metadata: DataFrame, p: Params) -> DataFrame:
    """Velocity from the last two samples, renamed ids, scaled and mirrored coordinates.

    `metadata` holds one row per match, or several with generation_ts and seq, of which the latest at a reading's time
    counts. Also keeps what later operators need of the metadata: the areas around the position and the field
    size, so that the metadata is joined once.
    """
    moved = scan(raw, [MATCH, "object_id"], ORDER, p.chunk_ms, Prev("__p", F.struct("x", "y", "z", TS)))
    dt = F.col(TS) - F.col(f"__p.{TS}")

    def speed(c: str) -> Column:
        return F.when((F.col("__p").isNotNull()) & (dt != 0), (F.col(c) - F.col(f"__p.{c}")) / dt).otherwise(0.0)

    if TS not in metadata.columns:
        # one row per match, stored: else the optimizer may merge this with a distinct below and parse per reading
        metadata = materialize(metadata.dropDuplicates([MATCH]), "match-metadata")
    # the texts are parsed once per match, not once per reading
    known = metadata.select(
        *[c for c in (MATCH, TS, SEQ) if c in metadata.columns], "field_length", "field_width", "mirrored_x", "mirrored_y",
        rename_map(F.col("object_rename_map")).alias("__objects"), rename_map(F.col("team_rename_map")).alias("__teams"),
        parse_areas(F.col("areas")).alias("__areas"),
    )
    moved = moved.select(*raw.columns, *[speed(c).alias(f"__v{c}") for c in "xyz"])
    told = [c for c in known.columns if c not in (MATCH, TS, SEQ)]
    if TS in known.columns:  # metadata that change: the latest of the match at the reading's time
        moved = asof_join(moved, known, [MATCH], {c: F.col(c) for c in told}, p.chunk_ms, crowded=False)
    else:
        moved = moved.join(known, MATCH, "left")

    def side(flag: str) -> Column:
        return F.when(F.coalesce(flag, F.lit(False)), -1.0).otherwise(1.0)

    states = moved.select(
        MATCH, TS, SEQ,
        renamed(F.col("object_id"), F.col("__objects")).alias("object_id"),
        renamed(F.col("team_id"), F.col("__teams")).alias("team_id"),
        (F.col("x") * p.position_scale * side("mirrored_x")).alias("x"),
        (F.col("y") * p.position_scale * side("mirrored_y")).alias("y"),
        (F.col("z") * p.position_scale).alias("z"),
        (F.col("__vx") * p.velocity_scale * side("mirrored_x")).alias("vx"),
        (F.col("__vy") * p.velocity_scale * side("mirrored_y")).alias("vy"),
        (F.col("__vz") * p.velocity_scale).alias("vz"),
        (norm3(F.col("__vx"), F.col("__vy"), F.col("__vz")) * p.velocity_scale).alias("vabs"),
        "field_length", "field_width", "__areas",
    )
    return states.withColumn("areas", areas_at(F.col("__areas"), F.col("x"), F.col("y"))).drop("__areas")


def area_event(states: DataFrame, p: Params) -> DataFrame:
    """Entering and leaving of areas per object; everybody starts outside.

    Each row carries the list of areas it lies in, so changes are set differences of two neighbouring
    lists: rows are multiplied by changes only, never by areas.
    """
    w = scan(
        states.select(MATCH, TS, SEQ, "object_id", "team_id", "x", "y", "z", "areas"),
        [MATCH, "object_id"], ORDER, p.chunk_ms, Prev("__p", F.col("areas")),
    )
    none = F.array().cast("array<string>")
    now, before = F.coalesce("areas", none), F.coalesce("__p", none)
    changes = F.concat(
        F.transform(F.array_except(now, before), lambda a: F.struct(F.lit(True).alias("in_area"), a.alias("area_id"))),
        F.transform(F.array_except(before, now), lambda a: F.struct(F.lit(False).alias("in_area"), a.alias("area_id"))),
    )
    rows = w.filter(F.size(changes) > 0).withColumn("__e", F.explode(changes))
    return done(rows.select(*ORDER, MATCH, "object_id", "team_id", "x", "y", "z", "__e.in_area", "__e.area_id")).select(
        MATCH, TS, SEQ, "object_id", "team_id", "x", "y", "z", "in_area", "area_id"
    )
