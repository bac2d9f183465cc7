"""The sample position trace: every row of `events` is one reading, computed from its own columns only.

23 consecutive event ids are one tick (the ball, eleven players of A, eleven of B), 144 ticks of 200 ms a
match. A 16-tick cycle carries the ball for 8 ticks and plays it to the next carrier for 8. No join and
no shuffle: the trace grows with `events` as a plain projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.params import AREAS_TEXT, FIELD_LENGTH, FIELD_WIDTH

SLOTS, TICKS, STEP_MS = 23, 144, 200


def _place(i: str) -> tuple[str, str]:
    x = f"(if({i} <= 11, -1, 1) * (8 + 10 * ((({i} - 1) % 11) div 4)) + 0.25D * (1 + {i} % 4) * (abs((t + 5 * {i}) % 40 - 20) - 10))"
    y = f"(-24.0D + 16 * ((({i} - 1) % 11) % 4) + 0.25D * (abs((t + 3 * {i}) % 24 - 12) - 6))"
    start = f"(t < 16 and {i} = 1 + m % 22)"
    return f"if({start}, 0.5D, {x})", f"if({start}, 0.0D, {y})"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_position rows derived from `events`."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    e = e.selectExpr("seq", "k", f"seq div {SLOTS} as g", f"cast(seq % {SLOTS} as int) as slot")
    e = e.selectExpr("*", f"g div {TICKS} as m", f"cast(g % {TICKS} as int) as t")
    e = e.selectExpr("*", "t div 16 as q", "t % 16 as p")
    e = e.selectExpr("*", "1 + (q * 7 + m) % 22 as c", "1 + ((q + 1) * 7 + m) % 22 as n")
    (cx, cy), (nx, ny), (sx, sy) = _place("c"), _place("n"), _place("slot")
    e = e.selectExpr(
        "*", f"{cx} as cx", f"{cy} as cy", f"{nx} as nx", f"{ny} as ny", f"{sx} as sx", f"{sy} as sy",
        "(q % 4 = 1 and p between 2 and 6 and slot = if(c <= 11, c + 11, c - 11)) as marks",
    )
    e = e.selectExpr(
        "*", "if(q = 0, 0.0D, cx + 0.5D) as fx",
        "if(q % 5 = 3, if(q % 2 = 0, 54.5D, -54.5D), nx + 0.5D) as gx",
        "if(q % 5 = 3, ((m + q) % 3) * 3.0D, ny) as gy",
    )
    return e.selectExpr(
        "concat('m', m) as match_id", f"cast(t * {STEP_MS} as bigint) as generation_ts", "seq",
        "case when slot = 0 then 'BALL' when slot <= 11 then concat('A', slot) else concat('B', slot - 11) end as object_id",
        "case when slot = 0 then 'BALL' when slot <= 11 then 'A' else 'B' end as team_id",
        "cast(case when slot = 0 then if(p < 8, fx, fx + (gx - fx) * (p - 7) / 8.0D) when marks then cx + 1.5D else sx end as double) as x",
        "cast(case when slot = 0 then if(p < 8, cy, cy + (gy - cy) * (p - 7) / 8.0D) when marks then cy + 0.5D else sy end"
        " + if(slot > 0 and slot % 5 = 0, 0.25D * (k % 3 - 1), 0) as double) as y",
        "cast(case when slot > 0 or p < 8 then 0 when q % 5 = 3 then if(q % 4 < 2, 1, 3) else 0.25D * least(p - 7, 15 - p) end as double) as z",
    )


def metadata(raw: DataFrame) -> DataFrame:
    """match_metadata rows of the matches in a trace."""
    return raw.select("match_id").distinct().select(
        "match_id",
        F.lit(FIELD_LENGTH).alias("field_length"), F.lit(FIELD_WIDTH).alias("field_width"),
        F.lit(False).alias("mirrored_x"), F.lit(False).alias("mirrored_y"),
        F.lit("").alias("object_rename_map"), F.lit("").alias("team_rename_map"),
        F.lit(AREAS_TEXT).alias("areas"),
    )
