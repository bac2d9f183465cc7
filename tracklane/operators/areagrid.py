"""Area events for any number of areas, through a grid of several cell sizes.

An area lies at the level whose cells are the first not smaller than it, so it covers four cells at most, however large it
is. A reading has one cell per level in use. Both meet by equality of match, level and cell, and the exact check follows; a
reading is never compared with the list of all areas, and no list of areas is carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.operators.asof import MATCH, ORDER, SEQ, TS
from tracklane.operators.ordered import Total, done, scan
from tracklane.params import Params


def _cell(v: Column, level: Column, cell: float) -> Column:
    return F.floor(v / (F.pow(F.lit(2.0), level) * cell))


def area_cells(areas: DataFrame, cell: float) -> DataFrame:
    """Areas (match_id, area_id, min_x, max_x, min_y, max_y) with each cell they touch; areas turned inside out have none."""
    size = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(cell))
    levels = areas.where("min_x <= max_x and min_y <= max_y").withColumn("level", F.ceil(F.log2(size / cell)).cast("int"))
    span = lambda c: F.explode(F.sequence(_cell(F.col(f"min_{c}"), F.col("level"), cell), _cell(F.col(f"max_{c}"), F.col("level"), cell)))
    return levels.withColumn("cell_x", span("x")).withColumn("cell_y", span("y"))


def areas_of(readings: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """`readings` (match_id, x, y, ...) with `area_id`, a row for each area they lie in; borders belong to the area."""
    cells = area_cells(areas, cell)
    levels = cells.groupBy(MATCH).agg(F.collect_set("level").alias("__levels"))  # about twenty at most: sizes double
    placed = readings.join(levels, MATCH).withColumn("level", F.explode("__levels")).drop("__levels")
    placed = placed.withColumns({f"cell_{c}": _cell(F.col(c), F.col("level"), cell) for c in "xy"})
    met = placed.join(cells, [MATCH, "level", "cell_x", "cell_y"])
    return met.where("x between min_x and max_x and y between min_y and max_y").select(*readings.columns, "area_id")


def area_event_grid(states: DataFrame, areas: DataFrame, p: Params, cell: float = 5.0) -> DataFrame:
    """Entering and leaving of areas per object, as `area_event` gives them; everybody starts outside.

    A reading in an area makes two rows, one for itself and one for the object's next reading. Where only one of both is
    there, the object has entered or left. Areas of no match of `states` and repeated areas change nothing.
    """
    columns = [MATCH, TS, SEQ, "object_id", "team_id", "x", "y", "z"]
    rows = done(scan(states.select(*columns), [MATCH, "object_id"], ORDER, p.chunk_ms, Total("no", F.lit(1).cast("bigint"))))
    inside = areas_of(rows.select(MATCH, "object_id", "no", "x", "y"), areas.dropDuplicates(), cell).select(MATCH, "object_id", "no", "area_id")
    now = inside.withColumns({"now": F.lit(True), "before": F.lit(False)})
    then = inside.withColumns({"no": F.col("no") + 1, "now": F.lit(False), "before": F.lit(True)})
    both = now.unionByName(then).groupBy(MATCH, "object_id", "no", "area_id").agg(F.max("now").alias("in_area"), F.max("before").alias("__was"))
    changes = both.where("in_area <> __was").drop("__was")
    return rows.join(changes, [MATCH, "object_id", "no"]).select(*columns, "in_area", "area_id")
