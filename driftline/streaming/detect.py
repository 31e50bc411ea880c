"""The batch folds on streams: the same step functions, one state for each key, rows in the order (event_time, event_id).

Any split into micro-batches gives the batch result (see ordered). The state holds the fold's state and the rows of one
lateness interval.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from driftline.config import BreakerConfig, CollectorConfig, CorrelationConfig, CusumConfig, EwmaConfig
from driftline.functions.metrics import hour_of_week, long_metrics
from driftline.operators import incidents, topology
from driftline.operators.folds import Step, breaker_step, cusum_step, ewma_step
from driftline.streaming.ordered import BUCKET_MS, InOrder, in_order


class Fold(InOrder):
    """A step function over rows of (us, event_id, values)."""

    def __init__(self, values: list[str], step: Step, out: list[str]) -> None:
        super().__init__(["us", "event_id", *values], 2)
        self.values, self.step, self.out = values, step, out

    def take(self, key, state, row):
        us, i, *v = row
        state, found = self.step(tuple(state) if state is not None else None, dict(zip(self.values, v, strict=True)) | {"us": us})
        return state, [Row(**dict(zip(self.out, (*key, us, i, *v, *f), strict=True))) for f in found]


def stream_fold(rows: DataFrame, keys: list[str], values: list[str], step: Step, out: list[tuple[str, str]], lateness: str) -> DataFrame:
    """rows: a stream with keys, event_time, event_id and values. Gives keys, event_time, event_id, values and what step gives."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [*keys, "us", "event_id", *values, *(c for c, _ in out)]
    schema = ", ".join([*(f"{c} {types[c]}" for c in keys), "us bigint", *(f"{c} {types[c]}" for c in ("event_id", *values)), *(f"{c} {t}" for c, t in out)])
    made = in_order(rows, keys, Fold(values, step, names), "event_time", lateness, schema)
    return made.withColumn("event_time", F.timestamp_micros("us")).select(*keys, "event_time", "event_id", *values, *(c for c, _ in out))


FIRED = [("signal", "string"), ("detector_value", "double"), ("threshold", "double")]


def _anomalies(fired: DataFrame, kind: str) -> DataFrame:
    return fired.select(F.lit(kind).alias("detector_type"), "stage_id", "metric", "signal", "detector_value", "threshold", F.col("z").alias("z_score"), F.col("event_time").alias("detected_at"), "fault_label", "event_id")


def cusum(scored: DataFrame, config: CusumConfig | None = None, lateness: str = "1 minute") -> DataFrame:
    """scored: a stream of (stage_id, metric, event_time, event_id, z, fault_label)."""
    return _anomalies(stream_fold(scored.filter("z IS NOT NULL"), ["stage_id", "metric"], ["z", "fault_label"], cusum_step(config or CusumConfig()), FIRED, lateness), "cusum")


def ewma(scored: DataFrame, config: EwmaConfig | None = None, lateness: str = "1 minute") -> DataFrame:
    return _anomalies(stream_fold(scored.filter("z IS NOT NULL"), ["stage_id", "metric"], ["z", "fault_label"], ewma_step(config or EwmaConfig()), FIRED, lateness), "ewma")


def breakers(outcomes: DataFrame, config: BreakerConfig | None = None, lateness: str = "1 minute") -> DataFrame:
    """outcomes: a stream of (stage_id, event_time, event_id, ok). The breaker's state after each."""
    out = [("state", "string"), ("failure_count", "int"), ("trip_count", "int"), ("opened_us", "bigint")]
    return stream_fold(outcomes, ["stage_id"], ["ok"], breaker_step(config or BreakerConfig()), out, lateness)


def z_scores(events: DataFrame, base: DataFrame) -> DataFrame:
    """A stream of events with z against a fitted (static) per-stage baseline; the join keeps no state."""
    z = F.when(F.col("baseline_std") != 0, (F.col("value") - F.col("baseline_mean")) / F.col("baseline_std"))
    return long_metrics(events).join(base.select("stage_id", "metric", "baseline_mean", "baseline_std"), ["stage_id", "metric"], "left").withColumn("z", z)


class Seasonal(InOrder):
    """Baselines (kind 0) and events (kind 1) of a stage and metric in one order: an event is scored by its slot's newest baseline."""

    def __init__(self) -> None:
        super().__init__(["us", "kind", "event_id", "slot", "value", "mean", "std", "fault_label"], 3)

    def take(self, key, state, row):
        us, kind, i, slot, value, mean, std, fault = row
        state = state or {}
        if kind == 0:
            state[str(slot)] = [mean, std]
            return state, []
        mean, std = state.get(str(slot), (None, None))
        z = (value - mean) / std if std and value is not None else None
        return state, [Row(stage_id=key[0], metric=key[1], us=us, event_id=i, value=value, z=z, fault_label=fault)]


def seasonal_z_scores(events: DataFrame, baselines: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """A stream of events scored by the baseline (of their stage, hour of week and metric) that was newest at their time. baselines: a
    stream too (stage_id, hour_of_week, metric, baseline_mean, baseline_std, fitted_at), so a refit is picked up where its time
    comes and nothing is restarted. Gives stage_id, metric, event_time, event_id, value, z, fault_label, as cusum() and ewma() take them."""
    void = lambda t: F.lit(None).cast(t)
    e = long_metrics(events).select("stage_id", "metric", "event_time", F.lit(1).alias("kind"), F.col("event_id").cast("long"), hour_of_week("event_time").alias("slot"), "value", void("double").alias("mean"), void("double").alias("std"), "fault_label")
    b = baselines.select("stage_id", "metric", F.col("fitted_at").alias("event_time"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("event_id"), F.col("hour_of_week").alias("slot"), void("double").alias("value"), F.col("baseline_mean").alias("mean"), F.col("baseline_std").alias("std"), void("string").alias("fault_label"))
    schema = "stage_id string, metric string, us bigint, event_id bigint, value double, z double, fault_label string"
    made = in_order(e.unionByName(b), ["stage_id", "metric"], Seasonal(), "event_time", lateness, schema)
    return made.select("stage_id", "metric", F.timestamp_micros("us").alias("event_time"), "event_id", "value", "z", "fault_label")


class Alerts(InOrder):
    """incidents.Correlator on a stream, with the evidence of open groups in a map of its own."""

    def __init__(self, config: CorrelationConfig, up: dict[str, set[str]]) -> None:
        super().__init__(["us", *incidents.MET[1:], *(c for c in incidents.PROOF if c not in incidents.MET)], len(incidents.MET))
        self.width, self.least, self.up = int(config.window_s * 1e6), config.min_co_occurrence, up

    def init(self, handle):
        super().init(handle)
        self.evidence = handle.getMapState("evidence", "serial bigint, n bigint", "row string")

    def take(self, key, state, row):
        us, stage = row[0], row[self.names.index("stage_id")]
        state = state or {"opened": 0, "open": []}
        state, out = self.passed(key, state, us)
        mine = {stage} | self.up.get(stage, set())
        for g in state["open"]:
            if mine & set(g["reach"]):
                break
        else:
            state["opened"] += 1
            g = {"serial": state["opened"], "start": us, "reach": [], "stages": [], "n": 0, "end": us}
            state["open"].append(g)
            self.handle.registerTimer(((us + self.width) // (BUCKET_MS * 1000) + 1) * BUCKET_MS)
        self.evidence.updateValue((g["serial"], g["n"]), (json.dumps(row),))
        g |= {"reach": sorted(mine | set(g["reach"])), "stages": sorted({stage, *g["stages"]}), "n": g["n"] + 1, "end": us}
        return state, out

    def passed(self, key, state, us):
        out = []
        for g in [g for g in (state or {"open": []})["open"] if us - g["start"] > self.width]:
            state["open"].remove(g)
            names = [(g["serial"], n) for n in range(g["n"])]
            if g["n"] >= self.least:
                out.append(Row(component_id=key[0], start=g["start"], end=g["end"], affected_stage_ids=g["stages"], event_count=g["n"], rows=[self.evidence.getValue(n)[0] for n in names]))
            for n in names:
                self.evidence.removeKey(n)
        return state, out


def alerts(anomalies: DataFrame, stages: DataFrame, config: CorrelationConfig | None = None, lateness: str = "1 minute") -> DataFrame:
    """A stream of anomalies to alerts, as incidents.correlate gives them; each once, when its window has passed the watermark.
    stages: the declared graph."""
    part = F.broadcast(topology.components(stages))
    a = anomalies.join(part, "stage_id", "left").withColumn("component_id", F.coalesce("component_id", "stage_id"))
    schema = "component_id string, start bigint, end bigint, affected_stage_ids array<string>, event_count bigint, rows array<string>"
    made = in_order(a, ["component_id"], Alerts(config or CorrelationConfig(), incidents.reachable(stages)), "detected_at", lateness, schema)
    names = ["us", *incidents.MET[1:], *(c for c in incidents.PROOF if c not in incidents.MET)]
    types = {f.name: f.dataType.simpleString() for f in anomalies.schema} | {"us": "bigint"}

    def value(x, c: str):
        raw = F.get(x, names.index("us" if c == "detected_at" else c))
        return F.timestamp_micros(raw.cast("bigint")).alias(c) if c == "detected_at" else raw.cast(types[c]).alias(c)

    texts = F.transform("rows", lambda r: F.from_json(r, F.lit("array<string>")))
    evidence = F.transform(texts, lambda x: F.struct(*(value(x, c) for c in incidents.PROOF)))
    return made.select(incidents.alert_id("component_id", "start", "affected_stage_ids").alias("alert_id"), "component_id", F.timestamp_micros("start").alias("triggered_at"), F.timestamp_micros("end").alias("closed_at"), "affected_stage_ids", "event_count", evidence.alias("evidence"))


def sessions(anomalies: DataFrame, config: CollectorConfig | None = None, lateness: str = "1 minute") -> DataFrame:
    """Hypotheses from a stream of anomalies, each given once its gap has passed the watermark. All share one key: sessions
    are global by definition, and anomalies are few. (A stream's session needs a key that isn't a constant.)"""
    config = config or CollectorConfig()
    g = anomalies.withWatermark("detected_at", lateness).groupBy(F.col("detected_at").isNull().alias("_all"), F.session_window("detected_at", f"{config.gap_s} seconds").alias("w"))
    out = g.agg(F.count("*").alias("evidence_count"), F.min("detected_at").alias("triggered_at"), F.max("detected_at").alias("closed_at"))
    return out.filter(F.col("evidence_count") >= config.min_events).select(incidents.hypothesis_id("triggered_at").alias("hypothesis_id"), "triggered_at", "closed_at", "evidence_count")
