"""Session helpers: where intermediate tables go and how they are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session names it.

    Only a local session that names none gets a fresh folder under /tmp; on a cluster a machine-local
    folder would be lost with its executor, so a missing setting is an error there.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="tracklane-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back: cuts lineage, survives executor loss, keeps column pruning."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
