"""Micro-batch ingestion: decode, count, split, append. A batch that runs again replaces what it wrote, so nothing doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline.config import IngestConfig
from driftline.functions import wire
from driftline.streaming import log, topics


def write_batch(rows: DataFrame, batch_id: int, table: str, dlq: str | None, topic: str) -> None:
    """Decoded rows: valid ones to table/batch=N, dead letters to dlq/batch=N (None: bad messages are left out). Rows come
    first, and the stream commits its offsets after both."""
    rows = rows.persist()
    try:
        rows.filter("error IS NULL").drop("error", "value", "key").write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        if dlq:
            wire.dead_letter(rows.filter("error IS NOT NULL"), topic).write.mode("overwrite").json(f"{dlq}/batch={batch_id}")
    finally:
        rows.unpersist()


def ingest(stream: DataFrame, table: str, checkpoint: str, dlq: str | None = None, topic: str = "pipeline.metrics", kind: str = "event", flush_interval_s: float | None = None) -> StreamingQuery:
    """stream: messages. flush_interval_s: time between batches; None takes what is there and stops. Messages are decoded once, and
    what was taken and what failed is counted in topics.DELIVERED."""
    rows = topics.counted(wire.decode(stream, kind=kind), F.col("error").isNotNull())
    w = rows.writeStream.foreachBatch(lambda df, n: write_batch(df, n, table, dlq, topic)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if flush_interval_s is None else w.trigger(processingTime=f"{flush_interval_s} seconds")).start()


def ingest_log(spark: SparkSession, topic: str, table: str, checkpoint: str, config: IngestConfig | None = None, dlq: str | None = None, kind: str = "event") -> StreamingQuery:
    """A topic log into the table in batches of batch_size messages; fewer go when the oldest has waited flush_interval_s."""
    config = config or IngestConfig()
    stream = log.stream(spark, topic, f"{checkpoint}/plan.json", max_rows=config.batch_size, min_rows=config.batch_size, max_age_s=config.flush_interval_s)
    return ingest(stream, table, f"{checkpoint}/stream", dlq, topic, kind, min(config.flush_interval_s, 0.5))


def settled(query: StreamingQuery, topic: str) -> bool:
    """Whether the query has taken all that the topic log holds now."""
    return {str(k): v for k, v in log.ends(log.segments(topic)).items()} == log.reached(query)


def batch_summary(batch: DataFrame) -> DataFrame:
    """Rows and the oldest event of each stage in a batch."""
    return batch.groupBy("stage_id").agg(F.count("*").alias("rows"), F.min("event_time").alias("oldest"))
