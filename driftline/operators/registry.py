"""A persisted registry of circuit breakers: keyed state that resumes where it stopped.

The table has each stage's breaker and its high-water mark, the newest row (event_time, event_id) that the breaker has seen.
advance() folds only rows beyond the marks, from the stored states, and commits with a version check (snapshots.Versions): a
second run over new rows gives what one run over all rows gives, a batch that comes again changes nothing, and a writer that
was overtaken folds again from the other's state. Rows at or before their stage's mark are late and are left out, as a
breaker in memory would have moved on too.

Only failures matter one by one. Runs of successes are taken together where the rows lie, in tasks dealt by stage and time;
what a stage's fold reads is a row for each failure and for each run of successes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import BreakerConfig
from driftline.operators.folds import breaker_step
from driftline.operators.snapshots import Versions

STATE = "stage_id string, state string, failure_count int, trip_count int, opened_us bigint, updated_at timestamp, last_event_id bigint"
COLUMNS = ("stage_id", "state", "failure_count", "trip_count", "opened_us", "updated_at", "last_event_id")


def runs(rows: DataFrame) -> DataFrame:
    """rows: stage_id, us, event_id, ok. (stage_id, part, seq, ok, first, last, last_id): each failure, and successes without a
    failure between them as one row (or as several, where tasks met)."""
    dealt = rows.repartitionByRange("stage_id", "us", "event_id").sortWithinPartitions("stage_id", "us", "event_id")
    names = ["stage_id", "part", "seq", "ok", "first", "last", "last_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, run = TaskContext.get().partitionId(), 0, None
        types = (pa.string(), pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 3)

        def told(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 7, types, strict=True)], names)

        for b in batches:
            out = []
            for stage, us, i, ok in zip(*(b.column(c).to_pylist() for c in ("stage_id", "us", "event_id", "ok")), strict=True):
                if run and ok and run[3] and run[0] == stage:
                    run[5], run[6] = us, i
                    continue
                if run:
                    out.append(run)
                run, seq = [stage, part, seq, bool(ok), us, us, i], seq + 1
            yield told(out)
        if run:
            yield told([run])

    return dealt.mapInArrow(pack, "stage_id string, part int, seq bigint, ok boolean, first bigint, last bigint, last_id bigint")


def fold_runs(told: DataFrame, state: DataFrame, config: BreakerConfig) -> DataFrame:
    """The breakers (STATE) of all stages in told, from the given ones (or closed) on."""
    old = state.select("stage_id", *(F.col(c).alias(f"old_{c}") for c in COLUMNS[1:5]))
    rows = told.join(old, "stage_id", "left").repartition("stage_id").sortWithinPartitions("stage_id", "part", "seq")
    step = breaker_step(config)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, mark, out = None, None, None, []
        for b in batches:
            for stage, ok, first, last, i, *was in zip(*(b.column(c).to_pylist() for c in ("stage_id", "ok", "first", "last", "last_id", *(f"old_{c}" for c in COLUMNS[1:5]))), strict=True):
                if stage != now:
                    if mark:
                        out.append((now, *state, *mark))
                    now, state = stage, tuple(was) if was[0] is not None else None
                # of a run of successes the first may close or reset, and the last shows whether an open one's backoff ended
                for us in (first, last) if ok and last != first else (last,):
                    state, _ = step(state, {"us": us, "ok": ok})
                mark = (last, i)
            mark = mark if now is not None else None
        if mark:
            out.append((now, *state, *mark))
        types = (pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 3)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 7, types, strict=True)], list(COLUMNS))

    made = rows.mapInArrow(fold, STATE.replace("timestamp", "bigint"))
    return made.withColumn("updated_at", F.timestamp_micros("updated_at"))


class BreakerRegistry:
    def __init__(self, spark: SparkSession, path: str, config: BreakerConfig | None = None) -> None:
        self.spark, self.config, self.table = spark, config or BreakerConfig(), Versions(spark, path)

    def load(self) -> DataFrame:
        """The breakers as they were last committed."""
        found = self.table.read()
        return self.spark.createDataFrame([], STATE) if found is None else found

    def horizon(self, stages: list[str]) -> object:
        """A time before which no row of these stages can be new; None if one has no breaker yet."""
        marks = {r.stage_id: r.updated_at for r in self.load().filter(F.col("stage_id").isin(stages)).select("stage_id", "updated_at").collect()}
        return min(marks.values()) if stages and len(marks) == len(set(stages)) else None

    def advance(self, outcomes: DataFrame, stages: list[str] | None = None) -> int:
        """Fold rows (stage_id, event_time, event_id, ok) beyond the marks. stages: all stages that may come, if known; then rows
        before the oldest mark aren't even read. Returns the version."""
        since = self.horizon(stages) if stages else None
        if since is not None:
            outcomes = outcomes.filter(F.col("event_time") >= F.lit(since))

        def change(old: DataFrame | None) -> DataFrame:
            old = self.spark.createDataFrame([], STATE) if old is None else old
            marks = old.select("stage_id", F.unix_micros("updated_at").alias("at"), "last_event_id")
            rows = outcomes.select("stage_id", F.unix_micros("event_time").alias("us"), F.col("event_id").cast("long").alias("event_id"), "ok")
            fresh = rows.join(marks, "stage_id", "left").filter("at IS NULL OR us > at OR us = at AND event_id > last_event_id").select("stage_id", "us", "event_id", "ok")
            new = fold_runs(runs(fresh), old, self.config)
            return new.unionByName(old.join(new.select("stage_id"), "stage_id", "left_anti").select(*new.columns)).coalesce(1)

        return self.table.update(change)

    def follow(self, outcomes: DataFrame, checkpoint: str):
        """Advance by each micro-batch of a stream. A batch that runs again is beyond no mark."""
        return outcomes.writeStream.foreachBatch(lambda df, n: self.advance(df) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
