"""Sliding-window statistics of a stage, at each event or at ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import WindowConfig
from driftline.functions.metrics import error_flag
from driftline.operators import panes

STATS = ("p50_latency_ms", "p95_latency_ms", "p99_latency_ms", "mean_latency_ms", "mean_row_count", "error_rate")


def _stats(n: Column, config: WindowConfig, p: Column, mean: Column, rows: Column, errors: Column) -> list[Column]:
    steady = n >= config.min_sample_count
    values = (F.get(p, 0), F.get(p, 1), F.get(p, 2), mean, rows, errors)
    return [n.alias("sample_count"), steady.alias("is_stable"), *(F.when(steady, v).alias(name) for name, v in zip(STATS, values, strict=True))]


def at_events(events: DataFrame, config: WindowConfig | None = None, capped: bool = False) -> DataFrame:
    """Statistics over [t - duration, t] at each event, NULL below min_sample_count. capped: only the newest `capacity` rows of
    the window count (in order of event_time, event_id), for windows that may hold more."""
    config = config or WindowConfig()
    rows = panes.statistics(events.withColumn("_rc", F.col("row_count").cast("double")).withColumn("_err", error_flag()), config.duration_s, config.capacity if capped else None)
    return rows.select(*events.columns, *_stats(F.col("_n"), config, F.array("_p50", "_p95", "_p99"), F.col("_latency"), F.col("_rows"), F.col("_errors")))


def at_ticks(events: DataFrame, tick_s: int, config: WindowConfig | None = None) -> DataFrame:
    """Statistics over [tick - duration, tick] for every tick that has an event. Each event is sent to the ticks that
    see it, so the join with the clock is an explode; rows grow by duration / tick."""
    config = config or WindowConfig()
    t, d = F.unix_micros("event_time"), int(config.duration_s * 1e6)
    step = tick_s * 1_000_000
    first = F.ceil(t / step).cast("bigint") * step
    ticks = F.sequence(first, F.floor((t + d) / step).cast("bigint") * step, F.lit(step))
    seen = events.withColumn("_err", error_flag()).withColumn("tick", F.explode(F.when(first <= F.floor((t + d) / step).cast("bigint") * step, ticks)))
    agg = seen.groupBy("stage_id", "tick").agg(F.count("*").alias("_n"), F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("_p"), F.avg("latency_ms").alias("_a"), F.avg("row_count").alias("_r"), F.avg("_err").alias("_e"))
    return agg.select("stage_id", F.timestamp_micros("tick").alias("tick"), *_stats(F.col("_n"), config, F.col("_p"), F.col("_a"), F.col("_r"), F.col("_e")))


def downsampled(events: DataFrame, resolution_s: int) -> DataFrame:
    """Tumbling windows; works on streams too (with a watermark)."""
    w = F.window("event_time", f"{resolution_s} seconds")
    g = events.withColumn("_err", error_flag()).groupBy("stage_id", w)
    return g.agg(F.count("*").alias("sample_count"), F.avg("latency_ms").alias("mean_latency_ms"), F.max("latency_ms").alias("max_latency_ms"), F.sum("row_count").alias("rows"), F.avg("_err").alias("error_rate")).select(
        "stage_id", F.col("window.start").alias("window_start"), "sample_count", "mean_latency_ms", "max_latency_ms", "rows", "error_rate"
    )
