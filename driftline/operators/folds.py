"""Ordered recurrences with reset: control charts and circuit breakers, one pure step function each.

The step functions define the recurrences; streams run them, and charts.detect gives the charts' results over tables in
parallel. keyed_fold runs a step over tables: rows are dealt by key, sorted by key and order inside each partition, and
streamed with one state per key; memory holds a batch and one state, whatever a key's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.config import BreakerConfig, CusumConfig, EwmaConfig
from driftline.operators.charts import cusum, ewma

__all__ = ["breaker_snapshot", "breaker_step", "breakers", "cusum", "cusum_step", "ewma", "ewma_step", "keyed_fold"]

Step = Callable[[Any, dict], tuple[Any, list[tuple]]]


def cusum_step(config: CusumConfig) -> Step:
    """State (upper, lower). Fires strictly above h, with the sum before its reset; a z that is NULL or no number leaves the state alone."""

    def step(state: tuple[float, float] | None, row: dict) -> tuple[tuple[float, float], list[tuple]]:
        up, lo = state or (0.0, 0.0)
        z, out = row["z"], []
        if z is None or z != z:
            return (up, lo), out
        up, lo = max(0.0, up + z - config.k), max(0.0, lo - z - config.k)
        if up > config.h:
            out.append(("upper", up, config.h))
            up = 0.0
        if lo > config.h:
            out.append(("lower", lo, config.h))
            lo = 0.0
        return (up, lo), out

    return step


def ewma_step(config: EwmaConfig) -> Step:
    """State (value, n). Fires strictly beyond the exact limit; a fire resets the value and keeps n."""
    lam = config.lam

    def step(state: tuple[float, int] | None, row: dict) -> tuple[tuple[float, int], list[tuple]]:
        e, n = state or (0.0, 0)
        z = row["z"]
        if z is None or z != z:
            return (e, n), []
        e, n = lam * z + (1 - lam) * e, n + 1
        limit = config.width * ((lam / (2 - lam)) * (1 - (1 - lam) ** (2 * n))) ** 0.5
        if e > limit:
            return (0.0, n), [("upper", e, limit)]
        if e < -limit:
            return (0.0, n), [("lower", e, limit)]
        return (e, n), []

    return step


def breaker_step(config: BreakerConfig) -> Step:
    """State (name, failures, trips, opened_us). Rows: ok (bool) at time us. A row first probes an open breaker whose
    backoff has passed; failures while open are ignored. Every row gives the state after it."""

    def step(state: tuple | None, row: dict) -> tuple[tuple, list[tuple]]:
        name, fails, trips, opened = state or ("closed", 0, 0, None)
        now = row["us"]
        if name == "open" and now - opened >= config.backoff(trips) * 1e6:
            name = "half_open"
        if row["ok"]:
            if name == "half_open":
                name, fails, opened = "closed", 0, None
            elif name == "closed":
                fails = 0
        elif name != "open":
            fails += 1
            if name == "half_open" or fails >= config.failure_threshold:
                name, fails, trips, opened = "open", 0, trips + 1, now
        return (name, fails, trips, opened), [(name, fails, trips, opened)]

    return step


def keyed_fold(rows: DataFrame, keys: list[str], order: list[str], step: Step, out: str, parts: int | None = None) -> DataFrame:
    """Runs step over each key's rows in order; every tuple that it gives becomes the row's columns and those of `out`
    (a DDL list). step runs on the executors, so it holds plain values only."""
    names = rows.columns
    extra = [x.strip().split(" ")[0] for x in out.split(",")]
    dealt = (rows.repartition(parts, *keys) if parts else rows.repartition(*keys)).sortWithinPartitions(*keys, *order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), out])
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[x.strip().split(" ")[1]] for x in out.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            cols = b.to_pydict()
            ks = list(zip(*(cols[k] for k in keys), strict=True))
            taken, made = [], []
            for i in range(b.num_rows):
                if ks[i] != key:
                    key, state = ks[i], None
                state, found = step(state, {c: v[i] for c, v in cols.items()})
                for f in found:
                    taken.append(i)
                    made.append(f)
            kept = b.take(pa.array(taken, pa.int64()))
            new = list(zip(*made, strict=True)) or [[]] * len(extra)
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(new, types, strict=True))], [*names, *extra])

    return dealt.mapInArrow(run, schema)


def breakers(outcomes: DataFrame, config: BreakerConfig | None = None) -> DataFrame:
    """outcomes: (stage_id, event_time, event_id, ok). The breaker's state after each."""
    rows = outcomes.select("stage_id", "event_time", "event_id", "ok", F.unix_micros("event_time").alias("us"))
    return keyed_fold(rows, ["stage_id"], ["event_time", "event_id"], breaker_step(config or BreakerConfig()), "state string, failure_count int, trip_count int, opened_us bigint").drop("us")


def breaker_snapshot(history: DataFrame) -> DataFrame:
    """The last state of each stage."""
    last = F.max_by(F.struct("state", "failure_count", "trip_count", "opened_us", F.col("event_time").alias("updated_at")), F.struct("event_time", "event_id"))
    return history.groupBy("stage_id").agg(last.alias("s")).select("stage_id", "s.*")
