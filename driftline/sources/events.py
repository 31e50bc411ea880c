"""Event sources: the stand-in table as telemetry, and the stored metrics table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import DEFAULT_STAGES


def pipeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as telemetry, in expressions only, so that filters reach the scan."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = F.array(*(F.lit(s[0]) for s in DEFAULT_STAGES))
    bad = F.col("event_type") == "error"
    return e.select(
        "event_id", F.get(names, F.col("user_id") % len(DEFAULT_STAGES)).alias("stage_id"), F.col("ts").cast("timestamp").alias("event_time"), F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("row_count"), F.length("props").cast("bigint").alias("payload_bytes"), F.when(bad, "error").otherwise("ok").alias("status"),
        F.when(bad, "error_burst").alias("fault_label"), F.lpad(F.lower(F.hex("event_id")), 32, "0").alias("trace_id"),
    )


def write_metrics(events: DataFrame, path: str, mode: str = "append") -> None:
    """pipeline_metrics: partitioned by month, clustered by stage and time for row-group skipping."""
    (
        events.withColumn("event_month", F.date_format("event_time", "yyyy-MM")).repartition("event_month", "stage_id").sortWithinPartitions("stage_id", "event_time")
        .write.mode(mode).partitionBy("event_month").parquet(path)
    )


def read_metrics(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Half-open [start, end); the month predicate prunes partitions, since Spark derives none from event_time."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter((F.col("event_month") >= start[:7]) & (F.col("event_time") >= F.lit(start).cast("timestamp")))
    if end is not None:
        df = df.filter((F.col("event_month") <= end[:7]) & (F.col("event_time") < F.lit(end).cast("timestamp")))
    return df
