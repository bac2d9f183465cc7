"""Parsers of the three configuration texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rename_map(text: Column) -> Column:
    """`{a:b}%{c:d}` as map<string,string>; an empty text is an empty map."""
    parts = F.filter(F.split(text, "%"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.split(F.trim(p, F.lit("{}")), ":"))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0].alias("k"), p[1].alias("v"))))


def renamed(ids: Column, names: Column) -> Column:
    """The id after renaming by a parsed map; ids the map does not know stay."""
    return F.coalesce(F.try_element_at(names, ids), ids)


def parse_areas(text: Column) -> Column:
    """`{id:minX@maxX@minY@maxY},...` as array of structs."""

    def one(p):
        name = F.split(F.trim(p, F.lit("{}")), ":")
        box = F.transform(F.split(name[1], "@"), lambda v: v.cast("double"))
        return F.struct(
            name[0].alias("area_id"), box[0].alias("min_x"), box[1].alias("max_x"),
            box[2].alias("min_y"), box[3].alias("max_y"),
        )

    return F.transform(F.split(text, ","), one)


def parse_roster(text: Column) -> Column:
    """`{A1:A},...` as array of (object_id, team_id)."""

    def one(p):
        pair = F.split(F.trim(p, F.lit("{}")), ":")
        return F.struct(pair[0].alias("object_id"), pair[1].alias("team_id"))

    return F.transform(F.split(text, ","), one)


def areas_at(areas: Column, x: Column, y: Column) -> Column:
    """Ids of the areas that contain the point, borders included."""
    hit = F.filter(areas, lambda a: x.between(a["min_x"], a["max_x"]) & y.between(a["min_y"], a["max_y"]))
    return F.transform(hit, lambda a: a["area_id"])
