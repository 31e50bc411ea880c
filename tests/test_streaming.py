"""Streams give what batch gives, however the rows are split."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from driftline import config
from driftline.operators import baseline, folds, windows
from driftline.sources.events import pipeline_events
from driftline.streaming import detect, ingest, topics

D = "/root/testdata/sf0.001"
END = "2024-03-01 00:00:00"


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()


@pytest.fixture
def split(spark, tmp_path):
    """Events in three time-ordered files, and a last row that moves the watermark past all."""
    e = pipeline_events(spark, D).filter("event_id < 400").withColumn("fault_label", F.coalesce("fault_label", F.lit("none")))
    for k, (a, b) in enumerate((("2024-01-01", "2024-01-09"), ("2024-01-09", "2024-01-20"), ("2024-01-20", "2024-02-20"))):
        e.filter((F.col("event_time") >= a) & (F.col("event_time") < b)).repartition(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{k}"))
    last = e.limit(1).withColumn("event_time", F.lit(END).cast("timestamp")).withColumn("event_id", F.lit(10**9).cast("long"))
    last.write.parquet(str(tmp_path / "in" / "p3"))
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return e, stream


def test_detectors(spark, split, tmp_path):
    e, stream = split
    base = baseline.fit(e, baseline.latest(e), seasonal=False)
    for kind, batch, live in (("cusum", folds.cusum, detect.cusum), ("ewma", folds.ewma, detect.ewma)):
        want = batch(baseline.z_scores(e, base)).select("stage_id", "metric", "signal", F.round("detector_value", 6), "event_id").collect()
        run(live(detect.z_scores(stream, base), lateness="30 days"), kind, tmp_path)
        got = spark.table(kind).filter("event_id < 1000000000").select("stage_id", "metric", "signal", F.round("detector_value", 6), "event_id").collect()
        assert want and sorted(want) == sorted(got)


def test_breakers(spark, split, tmp_path):
    e, stream = split
    c = config.BreakerConfig(2, 60.0, 3600.0, 2.0)
    want = folds.breakers(e.withColumn("ok", F.col("status") == "ok"), c).select("stage_id", "event_id", "state", "trip_count").collect()
    run(detect.breakers(stream.withColumn("ok", F.col("status") == "ok"), c, lateness="30 days"), "breakers", tmp_path)
    got = spark.table("breakers").filter("event_id < 1000000000").select("stage_id", "event_id", "state", "trip_count").collect()
    assert sorted(want) == sorted(got)


def test_downsampled_and_sessions(spark, split, tmp_path):
    e, stream = split
    run(windows.downsampled(stream.withWatermark("event_time", "30 days"), 3600), "tumbling", tmp_path)
    assert spark.table("tumbling").count() > 0
    a = stream.filter("status <> 'ok'").select(F.col("event_time").alias("detected_at"), "event_id")
    run(detect.sessions(a, config.CollectorConfig(3600.0), "30 days"), "hypotheses", tmp_path)
    got = spark.table("hypotheses").agg(F.sum("evidence_count")).first()[0]
    assert got and got <= e.filter("status <> 'ok'").count()


def test_ingestion_dead_letters_and_restart(spark, tmp_path):
    e = pipeline_events(spark, D).filter("event_id < 50")
    topic, table, dlq, ck = (str(tmp_path / x) for x in ("topic", "table", "dlq", "ck"))
    topics.publish(e, topic)
    bad = spark.createDataFrame([("k", "this is not valid json {", 0, 10**6)], topics.MESSAGE)
    bad.write.mode("append").json(topic)
    for _ in range(2):  # the second run finds nothing new
        q = ingest.ingest(topics.read_stream(spark, topic, 3), table, ck, dlq)
        q.awaitTermination(120)
    rows = spark.read.parquet(table)
    assert rows.count() == 50 and spark.read.json(dlq).count() == 1
    assert sorted(map(str, rows.select("stage_id", "event_time", "latency_ms", "trace_id").collect())) == sorted(map(str, e.select("stage_id", "event_time", "latency_ms", "trace_id").collect()))
    topics.publish(e.limit(1), topic)
    q = ingest.ingest(topics.read_stream(spark, topic, 3), table, ck, dlq)
    q.awaitTermination(120)
    end = time.monotonic() + 20  # listeners are told a moment later
    while topics.delivered(q)["rows_in"] < 52 and time.monotonic() < end:
        time.sleep(0.1)
    assert spark.read.parquet(table).count() == 51 and topics.delivered(q) == {"batches": 2, "rows_in": 52, "rows_out": 51, "failed": 1}
    assert ingest.batch_summary(rows).agg(F.sum("rows")).first()[0] == 50


def test_replay_of_a_range(spark, tmp_path):
    rows = spark.createDataFrame([("k", str(i), i % 2, i) for i in range(20)], topics.MESSAGE)
    rows.write.json(str(tmp_path / "log"))
    got = topics.read_range(spark, str(tmp_path / "log"), 0, 4, 8)
    assert sorted(r.offset for r in got.collect()) == [4, 6, 8] and got.filter("replayed").count() == 3
