"""Run a streaming frame over what its source holds now and read the result back as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.session import work_dir


def run_available(df: DataFrame, name: str, *, keys: list[str] | None = None) -> DataFrame:
    """All rows the stream emits for the data available now.

    Append results go to a parquet sink. With `keys` the stream runs in update mode: every micro-batch is
    written with its number and the newest row of each key is the result.
    """
    spark = df.sparkSession
    base = f"{work_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    out = f"{base}/rows"
    writer = df.writeStream.option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
    if keys is None:
        writer.outputMode("append").format("parquet").start(out).awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer.outputMode("update").foreachBatch(save).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "__batch")]
    newest = rows.groupBy(*keys).agg(F.max(F.struct("__batch", *rest)).alias("__n"))
    return newest.select(*keys, *[F.col(f"__n.{c}").alias(c) for c in rest])


#: Rows of a micro-batch that one task writes to a file, about.
FILE_ROWS = 250_000


def out_of_order(table: DataFrame, name: str, late_ms: int, *, batches: int = 4, time: str = "generation_ts", end: dict | None = None) -> DataFrame:
    """`table` as a stream of `batches` micro-batches whose rows come up to `late_ms` too early, as a pseudo-random choice has it.

    A micro-batch has as many files as its rows need, all written side by side. With `end` (values of the columns that must not
    be null) two last micro-batches hold a row a file far behind all others, so that the watermark passes them all; users filter
    these from their results.
    """
    spark = table.sparkSession
    path = f"{work_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    low, high, rows = table.agg(F.min(time), F.max(time), F.count("*")).first()
    low, high, files = low or 0, high or 0, max(1, rows // batches // FILE_ROWS)
    step = (high - low) // batches + 1
    early = F.pmod(F.xxhash64(*[F.col(c) for c in table.columns if c in (time, "seq")]), F.lit(late_ms))
    dealt = table.withColumn("__no", F.greatest(F.lit(0), F.floor((F.col(time) - early - low) / step)))
    for k in range(batches):
        dealt.filter(F.col("__no") == k).drop("__no").repartition(files).write.mode("append").parquet(path)
    if end is not None:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in table.schema])
        for k in (1, 2):  # the clock of an operator behind another may follow one micro-batch later
            last = spark.createDataFrame([tuple({**end, time: high + (k << 32)}.get(c) for c in table.columns)], schema).coalesce(1)
            for _ in range(files):  # one row in each file of a micro-batch
                last.write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def as_stream(table: DataFrame, *, files_per_trigger: int | None = None) -> DataFrame:
    """The files of a written table as a stream."""
    reader = table.sparkSession.readStream.schema(table.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder = table.select(F.input_file_name()).first()[0].rsplit("/", 1)[0]
    return reader.parquet(folder)
