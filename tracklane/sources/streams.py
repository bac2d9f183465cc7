"""Named streams: reading, writing, guarding, and what a broker adds to an element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracklane.operators.ordered import CHUNK
from tracklane.schemas import INPUT_STREAMS


RECORD = "key string, value string, offset long, append_ts long"


def read_stream(
    spark: SparkSession,
    names: list[str],
    *,
    schema: T.StructType,
    path: str | None = None,
    servers: str | None = None,
    streaming: bool = True,
    encoded: bool = False,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Elements of the named streams, from `path/<name>` parquet folders or from broker topics, as one frame.

    Each row has `topic`, `append_ts` (ms) and `offset` beside the columns of `schema`; files carry them
    as columns if they have them. Topics, and files with `encoded`, hold records: the key as text and the value as JSON,
    which is decoded by `schema`. A value that is not of the schema gives nulls in its columns.
    """
    if servers:
        reader = (spark.readStream if streaming else spark.read).format("kafka")
        raw = reader.option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(names)).load()
        return _decoded(raw.withColumn("append_ts", F.unix_millis("timestamp")), schema, "timestampType")
    parts = []
    for name in names:
        if streaming:
            reader = spark.readStream
            if files_per_trigger:
                reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        else:
            reader = spark.read
        rows = reader.schema(RECORD if encoded else schema).parquet(f"{path}/{name}").withColumn("topic", F.lit(name))
        parts.append(_decoded(rows, schema) if encoded else rows)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _decoded(records: DataFrame, schema: T.StructType, *more: str) -> DataFrame:
    kept = ["topic", "offset", "append_ts", *more, F.col("key").cast("string").alias("key")]
    return records.select(*kept, F.from_json(F.col("value").cast("string"), schema).alias("v")).select(*kept[:-1], "key", "v.*")


def write_records(df: DataFrame, name: str, path: str, *, key: str, append_ts: str = "generation_ts", offset: str = "seq") -> None:
    """Append rows as records to the folder of a topic: key as text, all columns as JSON."""
    df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), F.col(offset).cast("long").alias("offset"),
              F.col(append_ts).cast("long").alias("append_ts")).write.mode("append").parquet(f"{path}/{name}")


def check_output(name: str) -> None:
    if name in INPUT_STREAMS:
        raise ValueError(f"{name} is an input stream and may not be written")


def write_stream(df: DataFrame, name: str, path: str, *, width: int = 60_000, checkpoint: str | None = None) -> StreamingQuery | None:
    """Append derived rows to the folder of their stream, one directory per match.

    Batch rows are spread by match and time chunk first, so that a match of any size is written by many
    tasks and a small one as few files. A streaming frame needs a checkpoint folder.
    """
    check_output(name)
    if df.isStreaming:
        return (
            df.writeStream.format("parquet").partitionBy("match_id").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(f"{path}/{name}")
        )
    chunk = F.floor(F.col("generation_ts") / F.lit(width))
    spread = df.withColumn(CHUNK, chunk).repartition("match_id", CHUNK).drop(CHUNK)
    spread.write.mode("append").partitionBy("match_id").parquet(f"{path}/{name}")
    return None


def write_topic(df: DataFrame, name: str, servers: str, *, checkpoint: str | None = None):
    """Send rows to the topic of their stream, keyed by match (needs the broker connector on the classpath)."""
    check_output(name)
    out = df.select(F.col("match_id").alias("key"), F.to_json(F.struct("*")).alias("value"))
    if df.isStreaming:
        return (
            out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", name)
            .option("checkpointLocation", checkpoint).start()
        )
    out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", name).save()


def stream_guard(df: DataFrame, declared: str = "stream_name", topic: str = "topic") -> DataFrame:
    """Drop elements whose declared stream is not the topic they came from."""
    return df.filter(F.col(declared) == F.col(topic))


def arrival_metadata(df: DataFrame, append_ts: Column, offset: Column) -> DataFrame:
    """Expose the broker's append time and offset beside the element."""
    return df.withColumn("append_ts", append_ts).withColumn("offset", offset)


def processing_latency(df: DataFrame, object_id: str, *, enabled: bool = True) -> DataFrame:
    """Key, generation and processing time of one object's states, and the time between."""
    rows = df if enabled else df.filter(F.lit(False))
    return rows.filter(F.col("object_id") == object_id).select(
        "match_id", "generation_ts", "processing_ts", (F.col("processing_ts") - F.col("generation_ts")).alias("latency_ms")
    )


def latency_sketches(latencies: DataFrame, period_ms: int, k: int = 4096) -> DataFrame:
    """A quantile sketch per match and period of generation time, of about `k` values whatever the number of rows.

    Sketches can be stored and merged over any periods; a smaller sketch has a larger rank error, about 2.3 / k^0.9.
    """
    period = F.floor(F.col("generation_ts") / period_ms) * period_ms
    return latencies.groupBy("match_id", period.alias("period_ts")).agg(
        F.count("latency_ms").alias("n"), F.kll_sketch_agg_bigint("latency_ms", F.lit(k)).alias("sketch"))


def latency_percentiles(sketches: DataFrame, percentiles=(0.5, 0.95, 0.99), k: int = 4096) -> DataFrame:
    """Percentiles per match from the stored sketches of its periods: the smallest latency that so many do not exceed."""
    merged = sketches.where("n > 0").groupBy("match_id").agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"))
    return merged.select("match_id", "n", *[
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(q).cast("double")).alias(f"p{round(q * 100)}") for q in percentiles])
