"""Tables between steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a local master without one a new folder."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-driftline-")
    return where.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: what several later steps read is made once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(table: DataFrame, row_bytes: int, bound: int = 32 << 20) -> bool:
    """Whether a stored table of rows of about row_bytes is small enough to be sent to every executor."""
    return table.count() * row_bytes <= bound
