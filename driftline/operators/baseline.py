"""Seasonal baselines: fit, upsert, lookup and z-scores."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.config import FitConfig
from driftline.functions.metrics import error_flag, hour_of_week, long_metrics
from driftline.schemas import METRICS

SLOT = ("stage_id", "hour_of_week")


def fit(events: DataFrame, as_of: Column, config: FitConfig | None = None, seasonal: bool = True) -> DataFrame:
    """One aggregation for all metrics over [as_of - lookback, ...), then an unpivot. seasonal=False: one slot a stage."""
    config = config or FitConfig()
    keys = SLOT if seasonal else SLOT[:1]
    recent = events.filter(F.col("event_time") >= as_of - F.make_interval(days=F.lit(config.lookback_days)))
    values = {"latency_ms": F.col("latency_ms"), "row_count": F.col("row_count").cast("double"), "error_rate": error_flag()}
    aggs = [x for m, v in values.items() for x in (F.avg(v).alias(f"mean_{m}"), F.coalesce(F.stddev(v), F.lit(0.0)).alias(f"std_{m}"))]
    wide = recent.withColumn("hour_of_week", hour_of_week("event_time")).groupBy(*keys).agg(*aggs, F.count("*").alias("sample_count"))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"mean_{m}").alias("baseline_mean"), F.col(f"std_{m}").alias("baseline_std")) for m in values)))
    return wide.select(*keys, "sample_count", rows.alias("b")).select(*keys, "b.*", "sample_count")


def latest(events: DataFrame) -> Column:
    """The newest event time, as a literal: one small aggregate instead of the wall clock."""
    return F.lit(events.agg(F.max("event_time")).first()[0])


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = (*SLOT, "metric"), by: str = "fitted_at") -> DataFrame:
    """The newest row of each key; new wins ties. Write the result beside the table it was read from, then swap."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def z_scores(events: DataFrame, base: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Each event and metric with z, NULL where the slot is unknown or has no spread. base is a table of slots (168 for a
    stage and metric), left for the optimiser to broadcast by its size."""
    seasonal = "hour_of_week" in base.columns
    keys = [*(SLOT if seasonal else SLOT[:1]), "metric"]
    long = long_metrics(events, metrics)
    if seasonal:
        long = long.withColumn("hour_of_week", hour_of_week("event_time"))
    z = F.when(F.col("baseline_std") != 0, (F.col("value") - F.col("baseline_mean")) / F.col("baseline_std"))
    return long.join(base.select(*keys, "baseline_mean", "baseline_std"), keys, "left").withColumn("z", z)


def z_scores_as_of(events: DataFrame, versions: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Each event and metric with z by the baseline of its slot that was newest at its time (fitted_at <= event_time). versions: all
    fits of all slots; the versions of a slot become one row of intervals, so an event meets its slot once."""
    slot = [*SLOT, "metric"]
    line = Window.partitionBy(*slot).orderBy("fitted_at")
    spans = versions.select(*slot, "baseline_mean", "baseline_std", "fitted_at", F.lead("fitted_at").over(line).alias("until"))
    long = long_metrics(events, metrics).withColumn("hour_of_week", hour_of_week("event_time"))
    v = spans.select(*(F.col(c).alias(f"_{c}") for c in spans.columns))
    on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}") for c in slot)) & (F.col("event_time") >= F.col("_fitted_at")) & (F.col("_until").isNull() | (F.col("event_time") < F.col("_until")))
    z = F.when(F.col("_baseline_std") != 0, (F.col("value") - F.col("_baseline_mean")) / F.col("_baseline_std"))
    return long.join(v, on, "left").withColumn("z", z).drop(*v.columns)


class BaselineStore:
    """A fitted model with a time to live: refitted when it is asked for and stale, or when told to."""

    def __init__(self, fit_once: Callable[[], DataFrame], ttl_s: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        if ttl_s <= 0:
            raise ValueError("ttl_s is positive")
        self._fit, self._ttl, self._clock = fit_once, ttl_s, clock
        self._model: DataFrame | None = None
        self._at = 0.0

    def is_fresh(self) -> bool:
        return self._model is not None and self._clock() - self._at < self._ttl

    def get(self) -> DataFrame:
        return self._model if self.is_fresh() else self.refresh()

    def refresh(self) -> DataFrame:
        old, self._model = self._model, self._fit().cache()
        self._at = self._clock()
        if old is not None:
            old.unpersist()
        return self._model
