"""Keyed rows of a stream in the order of their time, whatever order and batches they come in.

Rows wait in their key's state, in buckets of a second, until the watermark has passed their bucket, and are then taken in
order: bucket by bucket, sorted inside. A batch touches the buckets of its own rows and those that become due, not all that
waits. Rows later than the watermark are dropped by it. The session needs the RocksDB state store
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BUCKET_MS = 1000


class InOrder(StatefulProcessor):
    """names: the columns that wait; the first is the time in microseconds, and rows are taken in order of the first `order` of them."""

    def __init__(self, names: list[str], order: int) -> None:
        self.names, self.order = names, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint", "rows string")
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new: dict[int, list] = {}
        for r in rows:
            new.setdefault(r[self.names[0]] // (BUCKET_MS * 1000), []).append([r[c] for c in self.names])
        for bucket, some in new.items():
            old = json.loads(self.waiting.getValue((bucket,))[0]) if self.waiting.containsKey((bucket,)) else []
            if not old:
                self.handle.registerTimer((bucket + 1) * BUCKET_MS)
            self.waiting.updateValue((bucket,), (json.dumps(old + some),))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        # what is registered below for a time that has passed would wait for another batch
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        due = sorted(b for (b,) in self.waiting.keys() if (b + 1) * BUCKET_MS <= upto)
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        out: list[Row] = []
        for b in due:
            rows = json.loads(self.waiting.getValue((b,))[0])
            self.waiting.removeKey((b,))
            rows.sort(key=lambda r: r[: self.order])
            for r in rows:
                state, found = self.take(key, state, r)
                out += found
        state, found = self.passed(key, state, upto // BUCKET_MS * BUCKET_MS * 1000)
        self.state.update((json.dumps(state),))
        return iter(out + found)

    def take(self, key: tuple, state: object, row: list) -> tuple[object, list[Row]]:
        """One row in order: the new state (as JSON holds it) and rows to give."""
        raise NotImplementedError

    def passed(self, key: tuple, state: object, us: int) -> tuple[object, list[Row]]:
        """All rows before us were taken."""
        return state, []

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, keys: list[str], processor: InOrder, time: str, lateness: str, schema: str) -> DataFrame:
    """rows: a stream with keys, `time` and the processor's columns but the first, which is made of time here."""
    us = F.unix_micros(time).alias(processor.names[0])
    kept = rows.select(*keys, time, us, *(c for c in processor.names[1:])).withWatermark(time, lateness)
    return kept.groupBy(*keys).transformWithState(processor, schema, "append", "eventTime")
