"""The topic log: capped batches, both triggers, restarts, pacing; alerts, baselines and counters on streams."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from driftline import config
from driftline.functions import wire
from driftline.operators import baseline, incidents
from driftline.sources.events import pipeline_events
from driftline.streaming import detect, ingest, log, replay, topics

D = "/root/testdata/sf0.001"
T0 = dt.datetime(2025, 6, 2)
LINE = [("well", "source", [], 0.0), ("pump", "transform", ["well"], 8.0), ("tank", "sink", ["pump"], 30.0), ("spring", "source", [], 0.0), ("pool", "sink", ["spring"], 6.0)]


def messages(spark, n, first=0):
    return spark.range(first, first + n).select(F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("key"), F.col("id").cast("string").alias("value"))


def collected(stream, tmp_path, name="q", seconds=0.2):
    """A query that keeps (batch, rows) of what it gets."""
    out = []
    q = stream.writeStream.foreachBatch(lambda df, n: out.append((n, df.collect())) and None).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime=f"{seconds} seconds").start()
    return q, out


def until(q, condition, seconds=60):
    end = time.monotonic() + seconds
    while not condition() and time.monotonic() < end:
        if q.exception():
            raise q.exception()
        time.sleep(0.05)
    assert condition()


def test_log_keeps_order_and_offsets(spark, tmp_path):
    topic = str(tmp_path / "topic")
    for k in range(3):
        log.append(messages(spark, 100, 100 * k), topic, 4, segment_rows=30)
    rows = log.read(spark, topic).collect()
    assert sorted(int(r.value) for r in rows) == list(range(300))
    for p in {r.partition for r in rows}:
        mine = sorted((r.offset, int(r.value), r.key) for r in rows if r.partition == p)
        assert [o for o, *_ in mine] == list(range(len(mine)))
        for key in {k for *_, k in mine}:
            values = [v for _, v, k in mine if k == key]
            assert values == sorted(values)
    assert all(s.end - s.start <= 30 for s in log.segments(topic))


def test_batches_are_capped_and_resume(spark, tmp_path):
    topic, plan = str(tmp_path / "topic"), str(tmp_path / "plan.json")
    log.append(messages(spark, 230), topic, 3)
    q, out = collected(log.stream(spark, topic, plan, max_rows=40), tmp_path)
    until(q, lambda: len(out) >= 3)
    q.stop()
    log.append(messages(spark, 50, 230), topic, 3)
    q, more = collected(log.stream(spark, topic, plan, max_rows=40), tmp_path)
    until(q, lambda: len({r.value for b in (*out, *more) for r in b[1]}) == 280)
    q.stop()
    batches = {n: rows for n, rows in (*out, *more)}  # a batch that ran again counts once
    assert all(len(rows) <= 40 for rows in batches.values())
    got = [(r.partition, r.offset) for rows in batches.values() for r in rows]
    assert len(got) == len(set(got)) == 280


def test_flush_by_rows_or_age(spark, tmp_path):
    topic, plan = str(tmp_path / "topic"), str(tmp_path / "plan.json")
    log.append(messages(spark, 30), topic, 2)
    q, out = collected(log.stream(spark, topic, plan, max_rows=50, min_rows=50, max_age_s=4.0), tmp_path)
    time.sleep(1.5)
    assert not [rows for _, rows in out if rows]  # too few, too young
    log.append(messages(spark, 60, 30), topic, 2)
    until(q, lambda: sum(len(rows) for _, rows in out) >= 50, 20)
    until(q, lambda: sum(len(rows) for _, rows in out) == 90, 30)  # the rest by age
    q.stop()
    assert [len(rows) for _, rows in out if rows] == [50, 40]


def test_a_lost_plan_is_told(spark, tmp_path):
    topic, plan = str(tmp_path / "topic"), tmp_path / "plan.json"
    log.append(messages(spark, 90), topic, 1)
    q, out = collected(log.stream(spark, topic, str(plan), max_rows=60), tmp_path)
    until(q, lambda: len(out) >= 2)
    q.stop()
    plan.unlink()
    q, _ = collected(log.stream(spark, topic, str(plan), max_rows=10), tmp_path)
    end = time.monotonic() + 30
    while q.isActive and time.monotonic() < end:
        time.sleep(0.1)
    assert "behind what was read" in str(q.exception())


def test_ingestion_by_batch_size(spark, tmp_path):
    e = pipeline_events(spark, D).filter("event_id < 120")
    topic, table, dlq, ck = (str(tmp_path / x) for x in ("topic", "table", "dlq", "ck"))
    log.append(topics.messages(e).union(spark.createDataFrame([("k", "torn {")], "key string, value string")), topic, 2)
    q = ingest.ingest_log(spark, topic, table, ck, config.IngestConfig(50, 1.0), dlq)
    until(q, lambda: ingest.settled(q, topic))
    counts = topics.DELIVERED[q.id]
    q.stop()
    assert spark.read.parquet(table).count() == 120 and spark.read.json(dlq).count() == 1
    assert (counts.rows, counts.failed) == (121, 1) and counts.batches >= 3
    assert max(r["count"] for r in spark.read.parquet(table).groupBy("batch").count().collect()) <= 50


def test_paced_replay(spark, tmp_path):
    e = pipeline_events(spark, D).filter("event_id < 400")
    topic, table, ck = (str(tmp_path / x) for x in ("topic", "table", "ck"))
    log.append(topics.messages(e), topic, 1)
    request = config.ReplayRequest(topic, 0, 20, 319, "h1", 20.0)
    q = replay.start(spark, request, table, ck)
    until(q, lambda: spark.read.schema("x int").parquet(table).count() > 40 if (tmp_path / "table").exists() else False)
    q.stop()
    assert spark.read.parquet(table).count() < 300
    stop = spark.read.parquet(table).agg(F.max("batch")).first()[0]
    q = replay.start(spark, request, table, ck)
    until(q, lambda: replay.done(q, request), 60)
    q.stop()
    batches = spark.read.parquet(table).filter(F.col("batch") > stop + 1).groupBy("batch", F.unix_micros("replayed_at").alias("us")).count().orderBy("us").collect()
    # the first after the restart began in another query's time, the last has what is left of the range
    rate = sum(b["count"] for b in batches[1:-1]) / ((batches[-2].us - batches[0].us) / 1e6)
    assert 0.9 * 20 < rate < 1.1 * 20, (rate, batches)
    rows = spark.read.parquet(table)
    assert rows.count() == 300 and rows.select("offset").distinct().count() == 300 and rows.filter("replayed and hypothesis_id = 'h1'").count() == 300
    assert rows.agg(F.min("offset"), F.max("offset")).first() == (20, 319)
    assert replay.run(spark, request, table, ck, 30.0) == 300  # all is there: nothing comes twice


def test_messages_back_from_the_log(spark, tmp_path):
    topic = str(tmp_path / "topic")
    e = pipeline_events(spark, D).filter("event_id < 60")
    log.append(topics.messages(e), topic, 3)
    back = wire.decode(log.read(spark, topic)).drop("key", "value", "partition", "offset", "error")
    assert sorted(map(str, back.collect())) == sorted(map(str, e.drop("event_id").collect()))


def anomaly_rows(n=150, seed=1):
    rng, rows, t = random.Random(seed), [], 0.0
    for k in range(n):
        t += rng.choice([0.0, 0.4, 3.0, 9.0, 45.0])
        rows.append(("ewma", rng.choice([s[0] for s in LINE]), "row_count", "lower", -1.5, 1.25, rng.gauss(0, 4), T0 + dt.timedelta(seconds=t), None, k))
    return rows


SCHEMA = "detector_type string, stage_id string, metric string, signal string, detector_value double, threshold double, z_score double, detected_at timestamp, fault_label string, event_id long"


@pytest.mark.parametrize("cuts", [(150,), (50, 51, 100, 150), tuple(range(15, 151, 15))])
def test_alerts_on_streams(spark, tmp_path, cuts):
    """Any split of the anomalies, in any order inside a file, gives the alerts of the batch."""
    rows = anomaly_rows()
    st, c = config.stages(spark, LINE), config.CorrelationConfig(30.0, 2)
    a = 0
    for k, z in enumerate(cuts):
        part = rows[a:z]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        a = z
    last = ("ewma", "nowhere", "row_count", "lower", 0.0, 1.0, 0.0, T0 + dt.timedelta(days=9), None, 10**6)
    spark.createDataFrame([last], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / "z"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"alerts_{len(cuts)}"
    q = detect.alerts(stream, st, c, "5 minutes").writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = incidents.correlate(spark.createDataFrame(rows, SCHEMA), st, c).collect()
    got = spark.table(name).collect()
    key = lambda r: (r.alert_id, r.component_id, r.triggered_at, r.closed_at, r.affected_stage_ids, r.event_count, [tuple(e) for e in r.evidence])
    assert len(want) > 8 and sorted(map(key, got)) == sorted(map(key, want))
    assert all([e.detected_at for e in r.evidence] == sorted(e.detected_at for e in r.evidence) for r in got)


def test_seasonal_scores_across_a_refit(spark, tmp_path):
    e = pipeline_events(spark, D).filter("event_id < 300").withColumn("fault_label", F.coalesce("fault_label", F.lit("none")))
    old = baseline.fit(e, baseline.latest(e)).withColumn("fitted_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    new = old.withColumn("baseline_mean", F.col("baseline_mean") + 5).withColumn("fitted_at", F.lit("2024-01-12 00:00:00").cast("timestamp"))
    versions = old.unionByName(new)
    end = F.lit("2024-04-01 00:00:00").cast("timestamp")
    for k, (a, z) in enumerate((("2023-12-01", "2024-01-10"), ("2024-01-10", "2024-03-01"))):
        for name, df, t in (("e", e, "event_time"), ("b", versions, "fitted_at")):
            df.filter((F.col(t) >= a) & (F.col(t) < z)).coalesce(1).write.parquet(str(tmp_path / name / f"p{k}"))
    e.limit(1).withColumn("event_time", end).write.parquet(str(tmp_path / "e" / "z"))
    old.limit(1).withColumn("fitted_at", end).write.parquet(str(tmp_path / "b" / "z"))
    read = lambda n, df: spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    q = detect.seasonal_z_scores(read("e", e), read("b", versions), "10 days").writeStream.format("memory").queryName("seasonal").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = baseline.z_scores_as_of(e, versions).select("event_id", "metric", F.round("z", 9).alias("z")).collect()
    got = spark.table("seasonal").filter("event_time < '2024-03-01'").select("event_id", "metric", F.round("z", 9).alias("z")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r.z for r in got}) > 30
