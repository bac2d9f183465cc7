"""Geometry as column expressions over structs with x, y, z (or vx, vy, vz)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x, y, z) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def minus(a: Column, b: Column) -> tuple[Column, Column, Column]:
    return a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"]


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def norm(v: Column) -> Column:
    return norm3(v["x"], v["y"], v["z"])


def distance(a: Column, b: Column, flat: bool = False) -> Column:
    """Euclidean distance, without z if `flat`."""
    x, y, z = minus(a, b)
    return F.sqrt(x * x + y * y) if flat else norm3(x, y, z)


def angle3(a, b) -> Column:
    """Angle between two (x, y, z) triples in [0, pi]; null if one has no length."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    length = norm3(*a) * norm3(*b)
    return F.when(length > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / length))))


def angle(a: Column, b: Column) -> Column:
    return angle3((a["x"], a["y"], a["z"]), (b["x"], b["y"], b["z"]))


def projected_norm3(a, b) -> Column:
    """Length of `a` along the direction of `b`; 0 if `b` has no length."""
    n = norm3(*b)
    return F.when(n > 0, (a[0] * b[0] + a[1] * b[1] + a[2] * b[2]) / n).otherwise(0.0)


def k_nearest(objects: Column, point: Column, k: int, max_dist: float | None = None, flat: bool = True) -> Column:
    """The `k` nearest objects as structs (dist, object_id, team_id, x, y, z); ties by object id."""
    near = F.transform(
        objects,
        lambda o: F.struct(
            distance(o, point, flat).alias("dist"), o["object_id"].alias("object_id"), o["team_id"].alias("team_id"),
            o["x"].alias("x"), o["y"].alias("y"), o["z"].alias("z"),
        ),
    )
    if max_dist is not None:
        near = F.filter(near, lambda o: o["dist"] <= max_dist)
    return F.slice(F.array_sort(near), 1, k)


def nearest(objects: Column, point: Column, max_dist: float | None = None, flat: bool = True) -> Column:
    """The nearest object within `max_dist`, or null."""
    return F.get(k_nearest(objects, point, 1, max_dist, flat), F.lit(0))


def attacked_goal(team: Column, left_team: Column, field_length: Column) -> Column:
    """Middle of the goal a team plays towards: the right one for the team on the left."""
    x = F.when(team == left_team, field_length / 2).otherwise(-field_length / 2)
    return vec(x, F.lit(0.0), F.lit(0.0))


def players_nearer_to_goal(objects: Column, player: Column, team: Column, goal: Column) -> Column:
    """How many opponents are nearer to the goal than the player."""
    own = distance(player, goal)
    return F.size(F.filter(objects, lambda o: (o["team_id"] != team) & (distance(o, goal) < own)))
