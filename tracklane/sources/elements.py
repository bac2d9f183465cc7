"""`events` rows as generic keyed rows and as stream elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, generation_ts (ms), seq, value, k."""
    return event_columns(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("generation_ts"),
        F.col("event_id").alias("seq"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with a header and a typed payload; every fourth is atomic, the others have a phase."""
    e = keyed_events(spark, sf_dir)
    turn = F.col("seq") % 4
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return e.select(
        F.col("event_type").alias("stream_name"), user.alias("match_id"), "generation_ts", "seq",
        (turn == 0).alias("atomic"),
        F.when(turn == 1, "START").when(turn == 2, "ACTIVE").when(turn == 3, "END").alias("phase"),
        F.array(user, F.col("event_type")).alias("object_identifiers"),
        F.when(F.col("k") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("g"), (F.col("k") % 5).cast("string")))).alias("group_identifiers"),
        F.array(F.struct(F.col("value").alias("x"), F.col("k").cast("double").alias("y"), F.lit(0.0).alias("z"))).alias("positions"),
        F.struct(
            F.col("k").alias("longValue"), (F.col("k") % 2 == 0).alias("boolValue"), F.col("event_type").alias("stringValue"),
            F.col("value").alias("doubleValue"), F.array("k", "seq").alias("repeatedValue"),
        ).alias("payload"),
    )
