"""Detector benchmark: labelled trials for each fault, both detectors, and recall, false-positive rate and lag."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.metrics import long_metrics
from driftline.operators import folds
from driftline.sources.simulator import inject, normal

#: Fixed values of the published setting: magnitudes, and the baselines that z-scores use.
MAGNITUDES = {"latency_spike": 4.0, "dropped_connection": 0.8, "schema_drift": 0.5, "partition_skew": 4.0, "throughput_collapse": 10.0, "error_burst": 0.9}
BASELINES = {"latency_ms": (50.0, 10.0), "row_count": (100.0, 20.0), "error_rate": (0.0, 0.1)}


@dataclass(frozen=True)
class Setting:
    trials: int = 5
    warm_up: int = 50
    fault: int = 30
    recovery: int = 20
    seed: int = 1


def trials(spark: SparkSession, setting: Setting | None = None) -> DataFrame:
    """One event a second, trials of a fault one after the other in one sequence; in_fault and idx within the fault's events."""
    c = setting or Setting()
    size = c.warm_up + c.fault + c.recovery
    out = None
    for kind, m in MAGNITUDES.items():
        i = F.col("id") % size
        rows = spark.range(c.trials * size).select(
            F.lit(kind).alias("stage_id"), "id", F.floor(F.col("id") / size).cast("int").alias("trial"), F.timestamp_seconds(1704067200 + F.col("id")).alias("event_time"),
            (50 + 2 * normal(F.lit(c.seed), F.lit(kind), "id", 1)).alias("latency_ms"), F.round(100 + 4 * normal(F.lit(c.seed), F.lit(kind), "id", 2)).cast("int").alias("row_count"),
            F.lit(1024).cast("bigint").alias("payload_bytes"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("fault_label"),
            i.between(c.warm_up, c.warm_up + c.fault - 1).alias("in_fault"), (i < c.warm_up).alias("in_warm_up"), (i - c.warm_up).alias("idx"),
        )
        spec = [(kind, kind, t * size + c.warm_up, c.fault - 1, m, c.seed + t) for t in range(c.trials)]
        rows = inject(rows, spec, "2024-01-01 00:00:00", ("stage_id", "id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def scored(events: DataFrame) -> DataFrame:
    mean = F.create_map(*(F.lit(x) for m, (a, _) in BASELINES.items() for x in (m, a)))
    std = F.create_map(*(F.lit(x) for m, (_, b) in BASELINES.items() for x in (m, b)))
    z = (F.col("value") - F.element_at(mean, F.col("metric"))) / F.element_at(std, F.col("metric"))
    return long_metrics(events).withColumn("z", z).withColumn("event_id", F.col("id"))


def report(events: DataFrame) -> DataFrame:
    """(fault_type, detector, trials, recall, false_positive_rate, mean_lag): events with a fire count, not fires."""
    z = scored(events)
    fired = folds.cusum(z).unionByName(folds.ewma(z)).select(F.col("stage_id"), F.col("event_id").alias("id"), "detector_type").distinct()
    kinds = F.explode(F.array(F.lit("cusum"), F.lit("ewma")))
    every = events.select("stage_id", "id", "trial", "in_fault", "in_warm_up", "idx", kinds.alias("detector_type"))
    marked = every.join(fired.withColumn("fire", F.lit(True)), ["stage_id", "id", "detector_type"], "left").withColumn("fire", F.coalesce("fire", F.lit(False)))
    one = marked.groupBy("stage_id", "detector_type", "trial").agg(
        F.max(F.col("fire") & F.col("in_fault")).alias("hit"), F.min(F.when(F.col("fire") & F.col("in_fault"), F.col("idx"))).alias("lag"),
        F.count_if(F.col("fire") & F.col("in_warm_up")).alias("false_fires"), F.count_if("in_warm_up").alias("calm"),
    )
    g = one.groupBy(F.col("stage_id").alias("fault_type"), F.col("detector_type").alias("detector"))
    return g.agg(F.count("*").alias("trials"), F.avg(F.col("hit").cast("double")).alias("recall"), (F.sum("false_fires") / F.sum("calm")).alias("false_positive_rate"), F.avg("lag").alias("mean_lag"))


def to_markdown(rows: DataFrame) -> str:
    """The report as a table: a dozen rows."""
    lines = ["| detector | fault | trials | recall | false-positive rate | mean lag (events) |", "|-|-|-|-|-|-|"]
    for r in rows.orderBy("detector", "fault_type").collect():
        lag = "-" if r.mean_lag is None else f"{r.mean_lag:.1f}"
        lines.append(f"| {r.detector} | {r.fault_type} | {r.trials} | {r.recall:.2f} | {r.false_positive_rate:.3f} | {lag} |")
    return "\n".join(lines)
