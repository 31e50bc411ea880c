"""Charts in segments give the fires of the plain fold, however rows are cut."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftline.config import CusumConfig, EwmaConfig
from driftline.operators import charts, folds

T0 = dt.datetime(2025, 6, 2)


def fold(step, values):
    state, out = None, []
    for i, v in enumerate(values):
        state, found = step(state, {"z": v})
        out += [(i, *f) for f in found]
    return out


def series(kind: str, n: int, rng: random.Random) -> list[float]:
    if kind == "noise":
        return [rng.gauss(0, 1.2) for _ in range(n)]
    if kind == "shift":
        return [rng.gauss(2.5 if 300 < k < 700 else 0, 1) for k in range(n)]
    if kind == "constant":  # fires in a rhythm that starts never share
        return [1.5 if k > 20 else 0.0 for k in range(n)]
    if kind == "slow":  # no fire for long, no return to zero either
        return [0.5137 if k % 2 else 0.5 for k in range(n)]
    if kind == "two values":
        return [4.2 if rng.random() < 0.4 else -0.3 for _ in range(n)]
    return [rng.choice([-6.0, 0.5, 0.0, 6.0, 1e9, -1e9]) for _ in range(n)]


def near(a, b):
    return len(a) == len(b) and all(x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-9, abs=1e-9) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("kind", ["noise", "shift", "constant", "slow", "two values", "extreme"])
@pytest.mark.parametrize("size", [1, 7, 64, 500])
def test_transfer_functions(kind, size):
    """Segments composed from their transfer functions alone give each segment the fold's state and fires."""
    z = series(kind, 1000, random.Random(f"{kind}{size}"))
    for c in (CusumConfig(), CusumConfig(h=2.0, k=0.0)):
        up = lo = 0.0
        out = []
        for a in range(0, len(z), size):
            part = z[a : a + size]
            was = charts.cusum_fires(part, up, lo, c.k, c.h)
            out += [(a + i, *f) for i, *f in was]
            f, g = charts.cusum_transfer(part, c.k, c.h), charts.cusum_transfer([-v for v in part], c.k, c.h)
            (up, x), (lo, y) = charts.cusum_after(f, up), charts.cusum_after(g, lo)
            assert (x or y) == bool(was)
        assert near(out, fold(folds.cusum_step(c), z))
    for c in (EwmaConfig(), EwmaConfig(lam=0.02, width=1.5), EwmaConfig(lam=1.0)):
        e, out = 0.0, []
        for a in range(0, len(z), size):
            part, limit = z[a : a + size], charts.limits(c, a, len(z[a : a + size]))
            was = charts.ewma_fires(part, e, c.lam, limit)
            out += [(a + i, *f) for i, *f in was]
            e, x = charts.ewma_after(charts.ewma_transfer(part, c.lam, limit), e)
            assert x == bool(was)
        assert near(out, fold(folds.ewma_step(c), z))


@pytest.mark.parametrize("size", [40, 1 << 15])
def test_one_key_over_all_tasks(spark, size):
    rng, rows = random.Random(2), []
    for stage, kind, n in (("hot", "shift", 3000), ("cold", "noise", 90), ("steady", "constant", 700)):
        z = series(kind, n, rng)
        rows += [(stage, "latency_ms", T0 + dt.timedelta(seconds=k // 3), k, v if k % 50 else rng.choice([None, float("nan")]), None) for k, v in enumerate(z)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "stage_id string, metric string, event_time timestamp, event_id long, z double, fault_label string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed = charts.segments(df, size)
        assert packed.filter("stage_id = 'hot'").select("part").distinct().count() >= 3
        assert packed.agg(F.sum("n")).first()[0] == sum(r[4] is not None and r[4] == r[4] for r in rows)
        got = charts.detect(df, CusumConfig(), EwmaConfig(), size).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for chart, step in (("cusum", folds.cusum_step(CusumConfig())), ("ewma", folds.ewma_step(EwmaConfig()))):
        for stage in ("hot", "cold", "steady"):
            mine = sorted((r for r in rows if r[0] == stage), key=lambda r: (r[2], r[3]))
            want = [(mine[i][3], *f) for i, *f in fold(step, [r[4] for r in mine])]
            have = sorted((r.event_id, r.signal, r.detector_value, r.threshold) for r in got if (r.detector_type, r.stage_id) == (chart, stage))
            assert near(have, sorted(want)), (chart, stage)
    assert charts.cusum(df.limit(0)).count() == 0
