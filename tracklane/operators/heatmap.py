"""Heatmaps in long format: one row per item, second and non-empty cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.operators.asof import MATCH, SEQ, TS
from tracklane.operators.keyed import item_rollup
from tracklane.operators.ordered import allowed
from tracklane.operators.speed import players
from tracklane.params import Params

SECOND = "second"


def _axis(v: Column, size: Column, n: int) -> Column:
    return F.when((v > -size / 2) & (v < size / 2), F.floor((v + size / 2) / (size / n)))


def heatmap_cell(states: DataFrame, p: Params) -> DataFrame:
    """Grid cell of each player reading strictly inside the field."""
    cells = players(states, p).select(
        MATCH, TS, SEQ, "object_id", "team_id",
        _axis(F.col("x"), F.col("field_length"), p.grid_x).alias("cell_x"),
        _axis(F.col("y"), F.col("field_width"), p.grid_y).alias("cell_y"),
    )
    return cells.filter("cell_x is not null and cell_y is not null")


def heatmap_second(cells: DataFrame) -> DataFrame:
    """Readings per second, item and cell. Counted per player first: the roll-up to teams sees counts only."""
    per = cells.groupBy(
        MATCH, F.floor(F.col(TS) / 1000).alias(SECOND), "object_id", "team_id", "cell_x", "cell_y"
    ).agg(F.count("*").alias("n"))
    return item_rollup(per, "object_id", "team_id").groupBy(MATCH, SECOND, "item", "cell_x", "cell_y").agg(F.sum("n").alias("n"))


def item_seconds(cells: DataFrame, p: Params) -> DataFrame:
    """Per item its first second inside the field, with the last second of the match."""
    first = item_rollup(
        cells.groupBy(MATCH, "object_id", "team_id").agg(
            F.min(F.floor(F.col(TS) / 1000)).alias("a"), F.max(F.floor(F.col(TS) / 1000)).alias("b")
        ), "object_id", "team_id",
    )
    item = first.groupBy(MATCH, "item").agg(F.min("a").alias("first_s"))
    return item.join(first.groupBy(MATCH).agg(F.max("b").alias("last_s")), MATCH)


def explode_range(df: DataFrame, low: Column, high: Column, name: str, block: int = 1024) -> DataFrame:
    """One row per whole number in [low, high], in two steps so that no array grows with the range."""
    cols = df.columns
    wide = df.withColumn("__lo", low).withColumn("__hi", high).filter("__lo <= __hi").withColumn(
        "__b", F.explode(F.sequence(F.floor(F.col("__lo") / block), F.floor(F.col("__hi") / block)))
    )
    a, b = F.greatest(F.col("__lo"), F.col("__b") * block), F.least(F.col("__hi"), F.col("__b") * block + block - 1)
    return wide.withColumn(name, F.explode(F.sequence(a, b))).select(*cols, name)


def heatmap_interval(seconds: DataFrame, spans: DataFrame, p: Params) -> DataFrame:
    """Cells of the last n seconds at every second of the match, per item and interval (0: whole match).

    A count adds to its cell when its second comes and leaves n seconds later; the running sum of those
    steps is constant between steps, so only steps are ordered and each is spread over its seconds at the end.
    """
    horizon = F.explode(F.array(*[F.lit(i).cast("bigint") for i in p.intervals_s])).alias("interval_s")
    gains = seconds.select("*", horizon)
    leaves = gains.filter("interval_s > 0").withColumn(SECOND, F.col(SECOND) + F.col("interval_s")).withColumn("n", -F.col("n"))
    keys = [MATCH, "item", "interval_s", "cell_x", "cell_y"]
    # one exchange and one sort; a key is one cell of one item, which has two steps a second at most
    each = gains.unionByName(leaves).filter(allowed(keys, [SECOND])).repartition(*keys)
    steps = each.groupBy(*keys, SECOND).agg(F.sum("n").alias("d"))
    w = Window.partitionBy(*keys).orderBy(SECOND)
    run = steps.select(*keys, SECOND, F.sum("d").over(w).alias("n"), F.lead(SECOND).over(w).alias("__next")).filter("n > 0")
    level = run.join(spans.select(MATCH, "item", "last_s"), [MATCH, "item"])
    until = F.least(F.coalesce(F.col("__next") - 1, F.col("last_s")), F.col("last_s"))
    level = level.withColumnRenamed(SECOND, "__from")
    return explode_range(level, F.col("__from"), until, SECOND).select(*keys, SECOND, "n")


def heatmap_rle(intervals: DataFrame, spans: DataFrame, p: Params) -> DataFrame:
    """Row-major cell text with runs of zeros as `0xN`, joined by `;`, and the total per item, interval, second.

    A group is one grid at most. Seconds at which a grid is empty come from the spans of the items.
    """
    size = p.grid_x * p.grid_y
    cell = F.struct((F.col("cell_x") * p.grid_y + F.col("cell_y")).alias("c"), F.col("n").alias("n"))
    keys = [MATCH, "item", "interval_s", SECOND]
    grids = intervals.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("__g"), F.sum("n").alias("total"))
    every = explode_range(spans, F.col("first_s"), F.col("last_s"), SECOND).select(
        MATCH, "item", SECOND, F.explode(F.array(*[F.lit(i).cast("bigint") for i in p.intervals_s])).alias("interval_s")
    )
    all_ = every.join(grids.hint("merge"), keys, "left")  # the grids are far larger than estimated: not through the driver
    g = F.coalesce("__g", F.array().cast("array<struct<c:bigint,n:bigint>>"))
    zeros = lambda k: F.when(k > 0, F.concat(F.lit("0x"), k.cast("string")))
    before = lambda i: F.when(i > 0, F.get(g, i - 1)["c"]).otherwise(F.lit(-1).cast("bigint"))
    texts = F.transform(g, lambda e, i: F.concat_ws(";", zeros(e["c"] - before(i) - 1), e["n"].cast("string")))
    last = F.coalesce(F.try_element_at(g, F.lit(-1))["c"], F.lit(-1).cast("bigint"))
    cells = F.concat_ws(";", texts, zeros(F.lit(size) - last - 1))
    return all_.select(*keys, F.lit(p.grid_x).alias("grid_x"), F.lit(p.grid_y).alias("grid_y"), F.coalesce("total", F.lit(0)).alias("total"), cells.alias("cells"))
