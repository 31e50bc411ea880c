"""Validated settings, and loaders for the declarative files."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from driftline.operators import topology
from driftline.schemas import FAULT, METRICS, RULE, STAGE


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _metrics(names: tuple[str, ...]) -> None:
    _need(bool(names), "at least one metric")
    for m in names:
        _need(m in METRICS, f"unknown metric {m!r}")


@dataclass(frozen=True)
class WindowConfig:
    duration_s: float = 60.0
    tick_s: float = 1.0
    min_sample_count: int = 5
    capacity: int = 1000

    def __post_init__(self) -> None:
        _need(self.duration_s > 0 and self.tick_s > 0, "durations are positive")
        _need(self.min_sample_count >= 1 and self.capacity >= 1, "counts are at least 1")


@dataclass(frozen=True)
class CusumConfig:
    h: float = 4.0
    k: float = 0.5
    metrics: tuple[str, ...] = METRICS

    def __post_init__(self) -> None:
        _need(self.h > 0, "h is positive")
        _need(self.k >= 0, "k isn't negative")
        _metrics(self.metrics)


@dataclass(frozen=True)
class EwmaConfig:
    lam: float = 0.3
    width: float = 3.0
    metrics: tuple[str, ...] = METRICS

    def __post_init__(self) -> None:
        _need(0 < self.lam <= 1, "lambda is in (0, 1]")
        _need(self.width > 0, "the width is positive")
        _metrics(self.metrics)


@dataclass(frozen=True)
class CollectorConfig:
    gap_s: float = 30.0
    min_events: int = 1

    def __post_init__(self) -> None:
        _need(self.gap_s > 0 and self.min_events >= 1, "gap_s is positive, min_events at least 1")


@dataclass(frozen=True)
class CorrelationConfig:
    window_s: float = 60.0
    min_co_occurrence: int = 2

    def __post_init__(self) -> None:
        _need(self.window_s > 0 and self.min_co_occurrence >= 1, "window_s is positive, min_co_occurrence at least 1")


@dataclass(frozen=True)
class BreakerConfig:
    failure_threshold: int = 5
    base_s: float = 1.0
    max_s: float = 60.0
    multiplier: float = 2.0

    def __post_init__(self) -> None:
        _need(self.failure_threshold >= 1, "failure_threshold is at least 1")
        _need(0 < self.base_s <= self.max_s, "0 < base_s <= max_s")
        _need(self.multiplier >= 1, "multiplier is at least 1")

    def backoff(self, trips: int) -> float:
        return min(self.base_s * self.multiplier ** (trips - 1), self.max_s)


@dataclass(frozen=True)
class FitConfig:
    lookback_days: int = 28

    def __post_init__(self) -> None:
        _need(self.lookback_days >= 1, "lookback_days is at least 1")


@dataclass(frozen=True)
class IngestConfig:
    batch_size: int = 500
    flush_interval_s: float = 5.0

    def __post_init__(self) -> None:
        _need(self.batch_size >= 1 and self.flush_interval_s > 0, "batch_size is at least 1, flush_interval_s positive")


@dataclass(frozen=True)
class ReplayRequest:
    topic: str
    partition: int
    start_offset: int
    end_offset: int  # inclusive
    hypothesis_id: str = ""
    rate_limit_rps: float = 100.0

    def __post_init__(self) -> None:
        _need(bool(self.topic) and self.partition >= 0, "a topic and a partition")
        _need(0 <= self.start_offset <= self.end_offset, "0 <= start_offset <= end_offset")
        _need(self.rate_limit_rps > 0, "rate_limit_rps is positive")


#: The default topology and policy are fixed values that queries are held to.
DEFAULT_STAGES = [
    ("source_postgres", "source", [], 0.0),
    ("source_kafka", "source", [], 0.0),
    ("transform_validate", "transform", ["source_postgres", "source_kafka"], 20.0),
    ("transform_aggregate", "transform", ["transform_validate"], 45.0),
    ("sink_warehouse", "sink", ["transform_aggregate"], 30.0),
]
DEFAULT_RULES = [
    (10, "latency_spike", "high", "source", "circuit_break"),
    (10, "dropped_connection", "high", None, "circuit_break"),
    (10, "error_burst", "high", None, "circuit_break"),
    (20, "throughput_collapse", None, None, "scale_consumer"),
    (20, "partition_skew", None, None, "reroute_traffic"),
    (30, "latency_spike", None, None, "rate_limit"),
    (30, "error_burst", None, None, "rate_limit"),
    (40, "schema_drift", None, None, "page_operator"),
    (50, "dropped_connection", None, "transform", "replay_range"),
    (999, None, None, None, "page_operator"),
]
ACTIONS = {"circuit_break", "scale_consumer", "reroute_traffic", "rate_limit", "page_operator", "replay_range"}


def stages(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or DEFAULT_STAGES, STAGE)


def load_stages(spark: SparkSession, path: str) -> DataFrame:
    """stages: a list of {stage_id, stage_type, upstream_ids, propagation_delay_ms}."""
    found = yaml.safe_load(Path(path).read_text())["stages"]
    loaded = stages(spark, [(s["stage_id"], s["stage_type"], list(s.get("upstream_ids") or []), float(s.get("propagation_delay_ms", 0))) for s in found])
    topology.validate(loaded)
    return loaded


def rules(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Rules (priority, fault_type, severity, stage_type, action) in stable order of priority; None is a wildcard."""
    given = sorted(rows or DEFAULT_RULES, key=lambda r: r[0])
    for r in given:
        _need(r[4] in ACTIONS, f"unknown action {r[4]!r}")
    _need(any(r[1:4] == (None, None, None) for r in map(tuple, given)), "a last rule without conditions is needed, or some cases match none")
    return spark.createDataFrame([(i, *r, f"{r[1] or 'any'}/{r[2] or 'any'}/{r[3] or 'any'}") for i, r in enumerate(given)], RULE)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """rules: a list of {priority, match: {fault_type, severity, stage_type}, action} or the same keys flat; '*' is a wildcard."""
    out = []
    for r in yaml.safe_load(Path(path).read_text())["rules"]:
        at = r.get("match", r)
        out.append((int(r["priority"]), *(None if at.get(k) in (None, "*") else at[k] for k in ("fault_type", "severity", "stage_type")), r["action"]))
    return rules(spark, out)


def fault_specs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows (fault_type, target_stage_id, start_offset_s, duration_s, magnitude, seed), applied in this order."""
    for r in rows:
        _need(r[3] > 0 and r[2] >= 0, "a fault has a start and a duration")
    return spark.createDataFrame([(i, r[0], r[1], float(r[2]), float(r[3]), float(r[4]), int(r[5])) for i, r in enumerate(rows)], FAULT)


@dataclass(frozen=True)
class Scenario:
    """A simulation: clock, topology, workload and faults."""

    start: str
    tick_ms: float
    stages: list[tuple]
    rate: float
    payload_mean: float
    payload_std: float
    seed: int
    faults: list[tuple]


def load_scenario(path: str) -> Scenario:
    doc = yaml.safe_load(Path(path).read_text())
    topo = yaml.safe_load((Path(path).parent / doc["topology"]).read_text())["stages"]
    w, c = doc["workload"], doc["clock"]
    return Scenario(
        str(c["start"]), float(c["tick_interval_ms"]), [(s["stage_id"], s["stage_type"], list(s.get("upstream_ids") or []), float(s.get("propagation_delay_ms", 0))) for s in topo],
        float(w["arrival_rate_lambda"]), float(w["payload_mean_bytes"]), float(w["payload_std_bytes"]), int(doc.get("seed", 0)),
        [(f["fault_type"], f["target_stage_id"], f["start_offset_s"], f["duration_s"], f["magnitude"], f.get("seed", 0)) for f in doc.get("faults", [])],
    )
