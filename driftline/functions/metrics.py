"""Scalar expressions of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.schemas import METRICS


def error_flag(status: str | Column = "status") -> Column:
    return F.when((F.col(status) if isinstance(status, str) else status) != "ok", 1.0).otherwise(0.0)


def metric(name: str) -> Column:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}")
    return error_flag() if name == "error_rate" else F.col(name).cast("double")


def long_metrics(events: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """A row for each event and metric."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), metric(m).alias("value")) for m in metrics)))
    return events.withColumn("_m", pairs).select(*events.columns, "_m.metric", "_m.value")


def hour_of_week(t: str | Column) -> Column:
    """0 for Monday 00:00 to 167 for Sunday 23:00, in the session's time zone (UTC)."""
    return (F.weekday(t) * 24 + F.hour(t)).cast("int")


def severity(p: str | Column) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low")


def health(p99: str = "p99_ms", breaker: str = "breaker_state") -> Column:
    return F.when(F.col(breaker) == "open", "red").when(F.col(p99) >= 500, "red").when(F.col(p99) >= 100, "amber").otherwise("green")


def iso(t: str | Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
