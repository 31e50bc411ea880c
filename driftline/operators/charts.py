"""Control charts in parallel inside one key: a segmented scan over CUSUM and EWMA recurrences that reset when they fire.

A key's rows are one sequence, and the state before a row depends on all rows before it. Still no task reads a whole key:

1. deal     rows are range-partitioned by key and time and packed into segments of SEGMENT rows at most, each one row of a
            stored table. A key with all rows spreads over all tasks.
2. sum up   each segment gives its transfer function, the state after it as a function of the state before it. As long as
            nothing fires a CUSUM is max-plus, s -> max(s + sum, low), and an EWMA is linear, e -> a e + b. A start state beyond
            a bound fires at a place that depends on the bound; from there the state is the reset one, so each such place has one
            end state, found by following resets to the segment's end (places that reset together are followed once).
3. compose  a key's transfer functions are applied one after the other to its first state: a row for each segment, streamed.
4. replay   only segments in which something fires are read again, from the start state that step 3 gave them, by plain loops.

The fires are those of the sequential fold. (Sums of a segment are added in another order than row by row; values may differ
in their last digits.) Rows without z, or with a z that is no number, leave the state alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.config import CusumConfig, EwmaConfig
from driftline.operators.stored import fits_broadcast, kept

SEGMENT = 1 << 15
KEYS = ("stage_id", "metric")
ORDER = ("event_time", "event_id")
#: Below this share of a segment's end state its start state is nothing beside a double's last digit.
GONE = 1e-18


def settled(first: Callable[[int], tuple[int | None, float]]) -> Callable[[int], float]:
    """first(j): where the path that was reset after place j fires next, or None and its end state. Returns the end state of
    the path from any reset, whatever it fires on its way."""
    known: dict[int, float] = {}

    def end(j: int) -> float:
        path = []
        while j not in known:
            path.append(j)
            at, s = first(j)
            if at is None:
                break
            j = at
        else:
            s = known[j]
        for p in path:
            known[p] = s
        return s

    return end


def climb(x: list[float], at: int, s: float, k: float, h: float) -> tuple[int | None, float]:
    """One side of a CUSUM from place `at` to its first fire, or to the end."""
    for i in range(at, len(x)):
        s = s + x[i] - k
        if s > h:
            return i, s
        if not s > 0.0:
            s = 0.0
    return None, s


def cusum_transfer(x: list[float], k: float, h: float) -> dict:
    """One side's transfer function: bounds (descending) above which a start state fires, each with its end state; else
    max(s + sum, low), or low if even zero fires."""
    end = settled(lambda j: climb(x, j + 1, 0.0, k, h))
    at, low = climb(x, 0, 0.0, k, h)
    total = best = 0.0
    bounds: list[list[float]] = []
    for i in range(len(x) if at is None else at):
        total += x[i] - k
        if total > best:
            best = total
            if bounds and bounds[-1][1] == (e := end(i)):
                bounds[-1][0] = h - total
            else:
                bounds.append([h - total, end(i)])
    return {"bounds": bounds, "sum": total, "low": low if at is None else end(at), "fires": at is not None}


def cusum_after(f: dict, s: float) -> tuple[float, bool]:
    """The state after a segment, and whether it fires in it."""
    for bound, end in f["bounds"]:
        if s > bound:
            return end, True
    return (f["low"], True) if f["fires"] else (max(s + f["sum"], f["low"]), False)


def limits(config: EwmaConfig, before: int, n: int) -> list[float]:
    """The chart's limits of rows before + 1 to before + n."""
    out: list[float] = []
    lam = config.lam
    for i in range(before + 1, before + n + 1):
        rest = (1 - lam) ** (2 * i)
        out.append(config.width * ((lam / (2 - lam)) * (1 - rest)) ** 0.5)
        if 1 - rest == 1.0:
            return out + [out[-1]] * (n - len(out))
    return out


def drift(z: list[float], at: int, e: float, lam: float, limit: list[float]) -> tuple[int | None, float]:
    """An EWMA from place `at` to its first fire, or to the end."""
    for i in range(at, len(z)):
        e = lam * z[i] + (1 - lam) * e
        if e > limit[i] or e < -limit[i]:
            return i, e
    return None, e


def ewma_transfer(z: list[float], lam: float, limit: list[float]) -> dict:
    """Ranges of start states, each narrower than the one before, outside which the chart fires, with the end state then;
    inside all of them a e + b."""
    end = settled(lambda j: drift(z, j + 1, 0.0, lam, limit))
    a, b, low, high = 1.0, 0.0, float("-inf"), float("inf")
    ranges, i = [], 0
    while i < len(z) and low <= high and a * (1 - lam) > GONE:
        a, b = a * (1 - lam), lam * z[i] + (1 - lam) * b
        tight = max(low, (-limit[i] - b) / a), min(high, (limit[i] - b) / a)
        if tight != (low, high):
            low, high = tight
            ranges.append([low, high, end(i)])
        i += 1
    fires = False
    if low <= high and i < len(z):  # all paths are one by now
        at, b = drift(z, i, b, lam, limit)
        a, fires = 0.0, at is not None
        b = end(at) if fires else b
    return {"ranges": ranges, "a": a, "b": b, "fires": fires}


def ewma_after(f: dict, e: float) -> tuple[float, bool]:
    for low, high, end in f["ranges"]:
        if e < low or e > high:
            return end, True
    return f["a"] * e + f["b"], f["fires"]


def segments(scored: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Stored: stage_id, metric, part and seq (their order inside a key), n, and lists z, event_time, event_id, fault_label."""
    rows = scored.filter(F.col("z").isNotNull() & ~F.isnan("z")).select(*KEYS, *ORDER, "z", "fault_label")
    dealt = rows.repartitionByRange(*KEYS, *ORDER).sortWithinPartitions(*KEYS, *ORDER)
    lists = ("z", *ORDER, "fault_label")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = "stage_id string, metric string, part int, seq int, n bigint, " + ", ".join(f"{c} array<{types[c]}>" for c in lists)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, count, now = TaskContext.get().partitionId(), 0, [], 0, None

        def told() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            own = [pa.array([v]) for v in now]
            cols = [*own, pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([t.num_rows], pa.int64())]
            for c in lists:
                v = t.column(c).combine_chunks()
                v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
                cols.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
            return pa.RecordBatch.from_arrays(cols, [*KEYS, "part", "seq", "n", *lists])

        for b in batches:
            codes = [b.column(c).dictionary_encode() for c in KEYS]
            keys = list(zip(*(c.indices.to_pylist() for c in codes), strict=True))
            a = 0
            while a < len(keys):
                z = a + 1
                while z < len(keys) and keys[z] == keys[a]:
                    z += 1
                key = tuple(c.dictionary[k].as_py() for c, k in zip(codes, keys[a], strict=True))
                while a < z:
                    if held and (key != now or count >= size):
                        yield told()
                        seq, held, count = seq + 1, [], 0
                    now = key
                    take = min(z - a, size - count)
                    held.append(b.slice(a, take))
                    a, count = a + take, count + take
        if held:
            yield told()

    return kept(dealt.mapInArrow(pack, schema), "chart-segments")


PLACE = (*KEYS, "part", "seq")


def _beside(packed: DataFrame, told: DataFrame) -> DataFrame:
    """packed segments with a stored row for each (told); broadcast by its size, else by a shuffle join."""
    return packed.join(F.broadcast(told) if fits_broadcast(told, 200) else told, list(PLACE))


def starts(packed: DataFrame, cusum: CusumConfig | None, ewma: EwmaConfig | None) -> DataFrame:
    """Stored: each segment with the states it starts from (up, lo, e; before: rows of its key before it), and which charts
    fire in it."""
    line = Window.partitionBy(*KEYS).orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each segment
    before = kept(packed.select(*PLACE, F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before")), "chart-places")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for metric, n0, zs in zip(b.column("metric").to_pylist(), b.column("before").to_pylist(), b.column("z"), strict=True):
                z, f = zs.values.to_pylist(), {}
                if cusum and metric in cusum.metrics:
                    f["up"], f["lo"] = cusum_transfer(z, cusum.k, cusum.h), cusum_transfer([-v for v in z], cusum.k, cusum.h)
                if ewma and metric in ewma.metrics:
                    f["e"] = ewma_transfer(z, ewma.lam, limits(ewma, n0, len(z)))
                out.append(json.dumps(f))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*PLACE, "before")), pa.array(out, pa.string())], [*PLACE, "before", "f"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, {}
        for b in batches:
            out = []
            for *key, f in zip(*(b.column(c).to_pylist() for c in (*KEYS, "f")), strict=True):
                if key != now:
                    now, state = key, {"up": 0.0, "lo": 0.0, "e": 0.0}
                was, fired = dict(state), {}
                for c, g in json.loads(f).items():
                    state[c], fired[c] = (ewma_after if c == "e" else cusum_after)(g, state[c])
                out.append((was["up"], was["lo"], was["e"], fired.get("up", False) or fired.get("lo", False), fired.get("e", False)))
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.float64()] * 3, *[pa.bool_()] * 2), strict=True)] if out else [pa.array([], t) for t in (*[pa.float64()] * 3, *[pa.bool_()] * 2)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*PLACE, "before")), *cols], [*PLACE, "before", "up", "lo", "e", "cusum_fires", "ewma_fires"])

    place = "stage_id string, metric string, part int, seq int, before bigint"
    told = _beside(packed.select(*PLACE, "z"), before).select(*PLACE, "before", "z").mapInArrow(sums, f"{place}, f string")
    told = told.repartition(*KEYS).sortWithinPartitions(*PLACE).mapInArrow(compose, f"{place}, up double, lo double, e double, cusum_fires boolean, ewma_fires boolean")
    return kept(told, "chart-starts")


def cusum_fires(z: list[float], up: float, lo: float, k: float, h: float) -> list[tuple]:
    """(place, signal, value, threshold) of a segment's fires."""
    out = []
    for i, v in enumerate(z):
        up, lo = up + v - k, lo - v - k
        if up > h:
            out.append((i, "upper", up, h))
            up = 0.0
        elif not up > 0.0:
            up = 0.0
        if lo > h:
            out.append((i, "lower", lo, h))
            lo = 0.0
        elif not lo > 0.0:
            lo = 0.0
    return out


def ewma_fires(z: list[float], e: float, lam: float, limit: list[float]) -> list[tuple]:
    out, at = [], 0
    while True:
        i, e = drift(z, at, e, lam, limit)
        if i is None:
            return out
        out.append((i, "upper" if e > 0 else "lower", e, limit[i]))
        at, e = i + 1, 0.0


ANOMALY = ("detector_type", "stage_id", "metric", "signal", "detector_value", "threshold", "z_score", "detected_at", "fault_label", "event_id")


def detect(scored: DataFrame, cusum: CusumConfig | None = None, ewma: EwmaConfig | None = None, size: int = SEGMENT) -> DataFrame:
    """Anomalies of rows with (stage_id, metric, event_time, event_id, z, fault_label), of the charts that are given, in one pass."""
    metrics = {m for c in (cusum, ewma) if c for m in c.metrics}
    packed = segments(scored.filter(F.col("metric").isin(*sorted(metrics))), size)
    hot = kept(starts(packed, cusum, ewma).filter("cusum_fires or ewma_fires"), "chart-fires")
    kind_of_id = packed.schema["event_id"].dataType.elementType.simpleString()
    schema = f"detector_type string, stage_id string, metric string, signal string, detector_value double, threshold double, z_score double, detected_at timestamp, fault_label string, event_id {kind_of_id}"

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                at = lambda c: b.column(c)[r]  # noqa: B023, E731
                z, metric, found = at("z").values.to_pylist(), at("metric").as_py(), []
                if at("cusum_fires").as_py():
                    found += [("cusum", *f) for f in cusum_fires(z, at("up").as_py(), at("lo").as_py(), cusum.k, cusum.h)]
                if at("ewma_fires").as_py():
                    found += [("ewma", *f) for f in ewma_fires(z, at("e").as_py(), ewma.lam, limits(ewma, at("before").as_py(), len(z)))]
                if not found:
                    continue
                kind, place, signal, value, limit = zip(*found, strict=True)
                i = pa.array(place, pa.int64())
                pick = lambda c: at(c).values.take(i)  # noqa: B023, E731
                cols = [pa.array(kind), pa.array([at("stage_id").as_py()] * len(i), pa.string()), pa.array([metric] * len(i)), pa.array(signal), pa.array(value, pa.float64()), pa.array(limit, pa.float64())]
                yield pa.RecordBatch.from_arrays([*cols, pick("z"), pick("event_time"), pick("fault_label"), pick("event_id")], list(ANOMALY))

    return _beside(packed, hot).mapInArrow(replay, schema)


def cusum(scored: DataFrame, config: CusumConfig | None = None, size: int = SEGMENT) -> DataFrame:
    return detect(scored, config or CusumConfig(), None, size)


def ewma(scored: DataFrame, config: EwmaConfig | None = None, size: int = SEGMENT) -> DataFrame:
    return detect(scored, None, config or EwmaConfig(), size)
