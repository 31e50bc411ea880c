"""Topics: Kafka where its package is on the class path, else a directory of JSON lines with the same columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from driftline.functions import wire
from driftline.operators.tables import replay

MESSAGE = "key string, value string, partition int, offset bigint"


def is_kafka(topic: str) -> bool:
    return topic.startswith("kafka://")


def _kafka(topic: str) -> dict[str, str]:
    servers, _, name = topic.removeprefix("kafka://").partition("/")
    return {"kafka.bootstrap.servers": servers, "topic": name}


def read_stream(spark: SparkSession, topic: str, per_trigger: int | None = None) -> DataFrame:
    """(key, value, partition, offset). topic: kafka://servers/name or a directory. per_trigger: messages (Kafka) or files."""
    if is_kafka(topic):
        o = _kafka(topic)
        r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", o["kafka.bootstrap.servers"]).option("subscribe", o["topic"]).option("startingOffsets", "earliest")
        r = r.option("maxOffsetsPerTrigger", per_trigger) if per_trigger else r
        return r.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset")
    r = spark.readStream.schema(MESSAGE)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).json(topic)


def read_range(spark: SparkSession, topic: str, partition: int, start_offset: int, end_offset: int) -> DataFrame:
    """Messages of an offset range (both ends count) for a replay, marked as replayed."""
    if is_kafka(topic):
        o = _kafka(topic)
        ends = lambda n: f'{{"{o["topic"]}":{{"{partition}":{n}}}}}'
        rows = spark.read.format("kafka").option("kafka.bootstrap.servers", o["kafka.bootstrap.servers"]).option("assign", f'{{"{o["topic"]}":[{partition}]}}').option("startingOffsets", ends(start_offset)).option("endingOffsets", ends(end_offset + 1)).load()
        rows = rows.select(F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset")
    else:
        rows = spark.read.schema(MESSAGE).json(topic)
    return replay(rows, partition, start_offset, end_offset)


def messages(rows: DataFrame, kind: str = "event") -> DataFrame:
    """Rows as wire messages keyed by their stage, so that a stage's messages keep their order."""
    return rows.select(F.col("stage_id").alias("key"), wire.encode(kind).alias("value"))


def publish(rows: DataFrame, topic: str, kind: str = "event") -> None:
    """One batch to the topic; a directory gets numbered messages in one partition for each file."""
    out = messages(rows, kind)
    if is_kafka(topic):
        out.write.format("kafka").options(**_kafka(topic), **{"kafka.acks": "all"}).save()
        return
    at = F.monotonically_increasing_id()
    out.select("key", "value", F.shiftright(at, 33).cast("int").alias("partition"), at.bitwiseAND((1 << 33) - 1).alias("offset")).write.mode("append").json(topic)


def publish_stream(rows: DataFrame, topic: str, checkpoint: str, kind: str = "event") -> StreamingQuery:
    """A stream to the topic, at least once into Kafka and exactly once into a directory."""
    rows = counted(rows, F.lit(False))
    if is_kafka(topic):
        return messages(rows, kind).writeStream.format("kafka").options(**_kafka(topic), **{"kafka.acks": "all"}).option("checkpointLocation", checkpoint).start()
    out = messages(rows, kind).select("key", "value", F.lit(0).alias("partition"), F.lit(None).cast("bigint").alias("offset"))
    return out.writeStream.format("json").option("path", topic).option("checkpointLocation", checkpoint).start()


@dataclass
class Delivery:
    """What a query has delivered since it was first started in this session: batches, rows and failed rows among them."""

    batches: int = 0
    rows: int = 0
    failed: int = 0
    last: int = -1


#: By query id, which a query keeps over restarts from its checkpoint.
DELIVERED: dict[str, Delivery] = {}


class Counter(StreamingQueryListener):
    """Adds up the observed metrics of every batch, not only of the recent ones that a query's progress holds."""

    def onQueryStarted(self, event) -> None:  # noqa: N802
        DELIVERED.setdefault(str(event.id), Delivery())

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        d = DELIVERED.setdefault(str(p.id), Delivery())
        seen = p.observedMetrics.get("delivery")
        if seen is not None and p.batchId > d.last and seen["rows"]:
            d.batches, d.rows, d.failed, d.last = d.batches + 1, d.rows + seen["rows"], d.failed + seen["failed"], p.batchId

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


_counting: set[str] = set()


def counted(stream: DataFrame, failed: Column) -> DataFrame:
    """The stream, whose rows and failed rows a listener adds up in DELIVERED."""
    spark = stream.sparkSession
    if spark.sparkContext.applicationId not in _counting:
        _counting.add(spark.sparkContext.applicationId)
        spark.streams.addListener(Counter())
    return stream.observe("delivery", F.count(F.lit(1)).alias("rows"), F.count(F.when(failed, 1)).alias("failed"))


def delivered(query: StreamingQuery) -> dict[str, int]:
    """Batches, rows and failed rows of the query's whole life in this session, restarts included."""
    d = DELIVERED.get(str(query.id), Delivery())
    return {"batches": d.batches, "rows_in": d.rows, "rows_out": d.rows - d.failed, "failed": d.failed}
