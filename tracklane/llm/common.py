"""Helpers of this subpackage: tables, folders, files that tasks write, running totals."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklane.session import materialize, work_dir

__all__ = ["materialize", "work_dir", "table", "partitions", "fresh_dir", "open_out", "open_in", "prefix_total", "text_of",
           "WORDS", "words_of"]

#: Words are runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Python tasks get it in batches of at most BATCH_ROWS rows, which bounds their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _split(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _plain(uri: str) -> str:
    return "file:///" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


class open_out:
    """A new file of a task under a name no other attempt uses; readers find it only through the rows the task returns."""

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{_plain(folder)}/{uuid.uuid4().hex}{suffix}"
        system, path = _split(self.uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self._out = system.open_output_stream(path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._out.close()


def open_in(uri: str) -> pa.NativeFile:
    system, path = _split(uri)
    return system.open_input_file(path)


def text_of(name: str, like: str = "") -> Column:
    return F.coalesce(F.col(name), F.lit(like))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(" + WORDS + ")"), F.lit(1))


def prefix_total(rows: DataFrame, order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Add `out`, the sum of `value` over all rows with a smaller `order` (distinct whole numbers from 0).

    Two levels: totals of blocks of `block` rows are summed in order, then rows inside their block, so one task holds
    one row per block.
    """
    b = F.floor(F.col(order) / block)
    per = rows.groupBy(b.alias("_block")).agg(F.sum(value).alias("_sum"))
    before = per.withColumn("_before", F.coalesce(
        F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("_block", b).join(before.drop("_sum"), "_block")
            .withColumn(out, F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_block", "_before"))


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pack(held, schema)
            held = []
    if held:
        yield pack(held, schema)


def pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
