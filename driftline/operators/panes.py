"""Sliding windows from panes, for exact statistics at each event without looking at a window's rows again for each row.

A window's rows are kept as ordered panes: short sorted runs of values with their counts. A row that comes or goes touches one
pane; a rank is found by adding up the panes' counts. Time is cut in slices of several windows: a slice reads its own rows and,
before them, those of one window, so slices of one key run in parallel and a row is read 1 + 1 / SLICES times. A ring bounds a
window to its newest `capacity` rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES, PANE = 8, 512
LEVELS = (0.5, 0.95, 0.99)
OUT = ("_n", "_p50", "_p95", "_p99", "_latency", "_rows", "_errors")


class Panes:
    """Values in order, as sorted runs of PANE at most (twice that before a run is split)."""

    def __init__(self) -> None:
        self.runs: list[list[float]] = []
        self.tops: list[float] = []  # the greatest value of each run
        self.n = 0

    def add(self, v: float) -> None:
        self.n += 1
        if not self.runs:
            self.runs, self.tops = [[v]], [v]
            return
        k = min(bisect_left(self.tops, v), len(self.runs) - 1)
        run = self.runs[k]
        insort(run, v)
        self.tops[k] = run[-1]
        if len(run) > 2 * PANE:
            self.runs[k : k + 1] = [run[:PANE], run[PANE:]]
            self.tops[k : k + 1] = [run[PANE - 1], run[-1]]

    def remove(self, v: float) -> None:
        self.n -= 1
        k = bisect_left(self.tops, v)
        run = self.runs[k]
        del run[bisect_left(run, v)]
        if run:
            self.tops[k] = run[-1]
        else:
            del self.runs[k], self.tops[k]

    def at(self, rank: int) -> float:
        for run in self.runs:
            if rank < len(run):
                return run[rank]
            rank -= len(run)
        raise IndexError(rank)

    def quantile(self, q: float) -> float | None:
        """Interpolated between ranks, as SQL's percentile does."""
        if not self.n:
            return None
        place = (self.n - 1) * q
        low = int(place)
        a = self.at(low)
        return a if place == low else a + (self.at(low + 1) - a) * (place - low)


class Sums:
    """Sum and count of what is in a window; whole numbers and dyadic fractions stay exact, others are summed anew now and then."""

    def __init__(self) -> None:
        self.n, self.total, self.gone = 0, 0.0, 0

    def add(self, v: float | None, sign: int = 1) -> None:
        if v is not None:
            self.n += sign
            self.total += sign * v

    def mean(self) -> float | None:
        return self.total / self.n if self.n else None


def slide(times: list[int], latency: list, rows: list, errors: list, window: deque, panes: list, width: int, capacity: int | None) -> list[tuple]:
    """(n, p50, p95, p99, mean latency, mean rows, mean errors) at each row of a batch in order of time. Without capacity, rows of
    one time see each other; with it, a row sees those before it in order. panes: [Panes, three Sums], kept with window."""
    out: list[tuple] = []

    def leave() -> None:
        _, x, r, e = window.popleft()
        if x is not None:
            panes[0].remove(x)
        for s, v in zip(panes[1:], (x, r, e), strict=True):
            s.add(v, -1)
        panes[1].gone += 1
        if panes[1].gone > 4096 + 4 * len(window):
            for k, s in enumerate(panes[1:], 1):
                s.total, s.gone = sum(w[k] for w in window if w[k] is not None), 0

    i = 0
    while i < len(times):
        z, t = i + 1, times[i]
        while not capacity and z < len(times) and times[z] == t:
            z += 1
        for k in range(i, z):
            x, r, e = latency[k], rows[k], errors[k]
            window.append((t, x, r, e))
            if x is not None:
                panes[0].add(x)
            for s, v in zip(panes[1:], (x, r, e), strict=True):
                s.add(v)
        while window and (window[0][0] < t - width or capacity and len(window) > capacity):
            leave()
        p = panes[0]
        out += [(len(window), *(p.quantile(q) for q in LEVELS), *(s.mean() for s in panes[1:]))] * (z - i)
        i = z
    return out


def statistics(events: DataFrame, duration_s: float, capacity: int | None = None) -> DataFrame:
    """events (stage_id, event_time, event_id, latency_ms, _rc, _err, ...) with OUT over [event_time - duration, event_time]."""
    width = int(duration_s * 1e6)
    step = max(1, width * SLICES)
    t = F.unix_micros("event_time")
    own = F.floor(t / step).cast("bigint")
    after = F.floor((t + width) / step).cast("bigint")
    names = events.columns
    sliced = events.select(*names, t.alias("_t"), own.alias("_own"), F.explode(F.sequence(own, after)).alias("_slice"))
    # a row with many others at its time would be torn from them by a batch's end, so batches are joined at equal times
    dealt = sliced.repartition("stage_id", "_slice").sortWithinPartitions("stage_id", "_slice", "_t", "event_id")
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "_n bigint", *(f"{c} double" for c in OUT[1:])])
    types = (pa.int64(), *[pa.float64()] * 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, window, panes, held = None, deque(), [], None

        def told(b: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal key, window, panes
            cols = {c: b.column(c).to_pylist() for c in ("stage_id", "_slice", "_own", "_t", "latency_ms", "_rc", "_err")}
            keys = list(zip(cols["stage_id"], cols["_slice"], strict=True))
            out, a = [], 0
            while a < len(keys):
                z = a + 1
                while z < len(keys) and keys[z] == keys[a]:
                    z += 1
                if keys[a] != key:
                    key, window, panes = keys[a], deque(), [Panes(), Sums(), Sums(), Sums()]
                out += slide(*(cols[c][a:z] for c in ("_t", "latency_ms", "_rc", "_err")), window, panes, width, capacity)
                a = z
            keep = pa.array([o == s for o, (_, s) in zip(cols["_own"], keys, strict=True)], pa.bool_())
            new = [pa.array(c, ty) for c, ty in zip(list(zip(*out, strict=True)) or [[]] * 7, types, strict=True)]
            return pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *new], [*names, *OUT]).filter(keep)

        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]  # noqa: PLW2901
            n = b.num_rows
            last = b.column("_t")
            cut = n
            while cut and last[cut - 1] == last[n - 1]:
                cut -= 1
            held = b.slice(cut)
            if cut:
                yield told(b.slice(0, cut))
        if held is not None:
            yield told(held)

    return dealt.mapInArrow(run, schema)
