"""A reproducible telemetry generator: draws are hashes of seed, stage and row, so no partitioning changes them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.config import Scenario

FAULTS = ("latency_spike", "dropped_connection", "schema_drift", "partition_skew", "throughput_collapse", "error_burst")


def uniform(*key: str | Column | int) -> Column:
    """In (0, 1), a function of its key alone."""
    cols = [F.lit(k) if isinstance(k, int) else k for k in key]
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def normal(*key: str | Column | int) -> Column:
    """Box and Muller's transform of two uniforms."""
    return F.sqrt(-2 * F.log(uniform(*key, 101))) * F.cos(2 * math.pi * uniform(*key, 102))


def lognormal_moments(mean: float, std: float) -> tuple[float, float]:
    s2 = math.log(1 + (std / mean) ** 2)
    return math.log(mean) - s2 / 2, math.sqrt(s2)


def poisson_events(spark: SparkSession, stage_id: str, n: int, start: str, rate: float, payload_mean: float, payload_std: float, seed: int = 0, chunk: int = 100_000) -> DataFrame:
    """n events of a stage: exponential gaps of mean 1 / rate, log-normal payload and latency, Poisson row counts (by their
    normal limit at 1000). Times are running sums, taken over chunks first and then over the chunks' totals, so that
    no window holds all rows."""
    if rate <= 0 or n < 0:
        raise ValueError("rate is positive and n isn't negative")
    mu, sigma = lognormal_moments(payload_mean, payload_std)
    key = (F.lit(seed), F.lit(stage_id), "seq")
    rows = spark.range(n).select(F.col("id").alias("seq"), F.floor(F.col("id") / chunk).alias("chunk")).withColumn("gap", -F.log(uniform(*key, 1)) / rate)
    totals = rows.groupBy("chunk").agg(F.sum("gap").alias("t"))
    before = totals.select("chunk", F.coalesce(F.sum("t").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    at = F.sum("gap").over(Window.partitionBy("chunk").orderBy("seq"))
    timed = rows.withColumn("s", at).join(before, "chunk").withColumn("us", F.unix_micros(F.lit(start).cast("timestamp")) + ((F.col("s") + F.col("before")) * 1e6).cast("bigint"))
    return timed.select(
        F.lit(stage_id).alias("stage_id"), F.timestamp_micros("us").alias("event_time"), F.exp(3.5 + 0.4 * normal(*key, 2)).alias("latency_ms"),
        F.greatest(F.lit(0), F.round(1000 + math.sqrt(1000) * normal(*key, 3))).cast("int").alias("row_count"), F.exp(mu + sigma * normal(*key, 4)).cast("bigint").alias("payload_bytes"),
        F.lit("ok").alias("status"), F.lit(None).cast("string").alias("fault_label"), F.lower(F.hex(F.xxhash64(*key, F.lit(5)))).alias("trace_id"), "seq",
    )


def inject(events: DataFrame, specs: list[tuple], start: str, key: tuple[str, ...] = ("stage_id", "seq")) -> DataFrame:
    """Applies fault specs (type, stage, start_offset_s, duration_s, magnitude, seed) in order; both ends of a window count."""
    for i, (kind, stage, offset, duration, m, seed) in enumerate(specs):
        if kind not in FAULTS:
            raise ValueError(f"unknown fault {kind!r}")
        at = (F.unix_micros("event_time") - F.unix_micros(F.lit(start).cast("timestamp"))) / 1e6
        hit = (F.col("stage_id") == stage) & (at >= float(offset)) & (at <= float(offset + duration))
        u = uniform(F.lit(seed), F.lit(i), *key)
        chance = hit & (u < m)
        put = lambda cond, c, v: F.when(cond, v).otherwise(F.col(c))
        change: dict[str, Column] = {"fault_label": put(hit, "fault_label", F.lit(kind))}
        if kind == "latency_spike":
            change["latency_ms"] = put(hit, "latency_ms", F.col("latency_ms") * m * (0.8 + 0.4 * u))
        elif kind == "dropped_connection":
            change |= {"status": put(chance, "status", F.lit("error")), "row_count": put(chance, "row_count", F.lit(0)), "payload_bytes": put(chance, "payload_bytes", F.lit(0).cast("bigint")), "latency_ms": put(chance, "latency_ms", F.col("latency_ms") * 3)}
        elif kind == "schema_drift":
            change |= {"row_count": put(hit, "row_count", (F.col("row_count") * max(0.0, 1 - m)).cast("int")), "status": put(hit, "status", F.lit("schema_error"))}
        elif kind == "partition_skew":
            change |= {"payload_bytes": put(hit, "payload_bytes", (F.col("payload_bytes") * m).cast("bigint")), "latency_ms": put(hit, "latency_ms", F.col("latency_ms") * m)}
        elif kind == "throughput_collapse":
            change["row_count"] = put(hit, "row_count", F.greatest(F.lit(1), (F.col("row_count") / m).cast("int")))
        else:
            change["status"] = put(chance, "status", F.lit("error"))
        events = events.withColumns(change)
    return events


def simulate(spark: SparkSession, scenario: Scenario, ticks: int) -> DataFrame:
    """All stages' events before the simulation ends, with faults, in time order, with the tick that releases each."""
    seconds = ticks * scenario.tick_ms / 1000
    n = int(2 * scenario.rate * seconds) + 100
    out = None
    for k, s in enumerate(scenario.stages):
        one = poisson_events(spark, s[0], n, scenario.start, scenario.rate, scenario.payload_mean, scenario.payload_std, scenario.seed).withColumn("stage_ord", F.lit(k))
        out = one if out is None else out.unionByName(one)
    t0 = F.unix_micros(F.lit(scenario.start).cast("timestamp"))
    kept = out.filter(F.unix_micros("event_time") < t0 + int(seconds * 1e6))
    tick = F.floor((F.unix_micros("event_time") - t0) / (scenario.tick_ms * 1000)).cast("int")
    return inject(kept, scenario.faults, scenario.start).withColumn("tick", tick).orderBy("event_time", "stage_ord", "seq")


def clock(spark: SparkSession, start: str, tick_ms: int, ticks: int) -> DataFrame:
    """tick, current_time = start + tick * interval (multiplied, so that no error adds up), elapsed_s."""
    us = F.unix_micros(F.lit(start).cast("timestamp")) + F.col("id") * (tick_ms * 1000)
    return spark.range(ticks + 1).select(F.col("id").alias("tick"), F.timestamp_micros(us).alias("current_time"), (F.col("id") * tick_ms / 1000.0).alias("elapsed_s"))
