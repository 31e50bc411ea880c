"""Paced replay of an offset range into the metrics table, resumed where it stopped."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline.config import ReplayRequest
from driftline.functions import wire
from driftline.streaming import log


def start(spark: SparkSession, request: ReplayRequest, table: str, checkpoint: str, interval_s: float = 0.25) -> StreamingQuery:
    """Release the request's messages at rate_limit_rps, decode them and append them to table, marked as replayed. A batch that
    runs again replaces what it wrote, and the checkpoint holds the place, so a stop repeats nothing and leaves nothing out."""
    rows = log.stream(spark, request.topic, f"{checkpoint}/plan.json", partition=request.partition, start=request.start_offset, end=request.end_offset, rate=request.rate_limit_rps)

    def write(batch: DataFrame, n: int) -> None:
        told = wire.decode(batch).withColumn("replayed", F.lit(True)).withColumn("hypothesis_id", F.lit(request.hypothesis_id)).withColumn("replayed_at", F.current_timestamp())
        told.filter("error IS NULL").drop("error", "value", "key").write.mode("overwrite").parquet(f"{table}/batch={n}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/stream").trigger(processingTime=f"{interval_s} seconds").start()


def done(query: StreamingQuery, request: ReplayRequest) -> bool:
    """Whether all of the range that the log holds was replayed."""
    last = min(request.end_offset + 1, log.ends(log.segments(request.topic)).get(request.partition, 0))
    return last <= request.start_offset or log.reached(query).get(str(request.partition), 0) >= last


def run(spark: SparkSession, request: ReplayRequest, table: str, checkpoint: str, timeout_s: float = 3600.0) -> int:
    """Replay to the end of the range and stop; how many messages the range has. TimeoutError if it takes longer: start again to go on."""
    query, until = start(spark, request, table, checkpoint), time.monotonic() + timeout_s
    try:
        while not done(query, request):
            if query.exception():
                raise query.exception()
            if time.monotonic() > until:
                raise TimeoutError(f"replay of {request.topic} isn't at its end after {timeout_s} s")
            time.sleep(0.1)
    finally:
        query.stop()
    return spark.read.parquet(table).count()
