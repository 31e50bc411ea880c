"""Versions, the breaker registry, panes and quantiles against plain code."""

from __future__ import annotations

import datetime as dt
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline import config
from driftline.operators import folds, quantiles, windows
from driftline.operators.registry import BreakerRegistry
from driftline.operators.snapshots import Conflict, Versions
from driftline.schemas import EVENT

T0 = dt.datetime(2025, 6, 2)


def test_two_writers_of_one_version(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"))
    assert t.version() == 0 and t.read() is None
    assert t.commit(spark.range(3), 0) == 1
    t.commit(spark.range(5), 1)
    with pytest.raises(Conflict):
        t.commit(spark.range(9), 1)
    assert t.read().count() == 5 and t.read(1).count() == 3 and t.vacuum(1) == 1 and t.versions() == [2]
    assert len(list((tmp_path / "t").glob("rows-*"))) == 1  # what lost or is old leaves nothing


def test_concurrent_updates_all_survive(spark, tmp_path):
    path = str(tmp_path / "t")
    Versions(spark, path).commit(spark.range(0), 0)
    fails = []

    def add(k: int) -> None:
        try:
            Versions(spark, path).append(lambda old: spark.range(k, k + 1))
        except Exception as e:  # noqa: BLE001
            fails.append(e)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(6)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not fails and sorted(r.id for r in Versions(spark, path).read().collect()) == list(range(6)) and Versions(spark, path).version() == 7


def test_upsert_and_insert(spark, tmp_path):
    row = lambda k, v, t: (k, v, T0 + dt.timedelta(seconds=t))
    df = lambda *rows: spark.createDataFrame(rows, "k string, v int, fitted_at timestamp")
    t = Versions(spark, str(tmp_path / "t"))
    t.upsert(df(row("a", 1, 0), row("b", 1, 5)), ("k",), "fitted_at")
    t.upsert(df(row("a", 2, 0), row("b", 2, 4), row("c", 2, 0)), ("k",), "fitted_at")
    assert {r.k: r.v for r in t.read().collect()} == {"a": 2, "b": 1, "c": 2}
    t.insert_new(df(row("a", 9, 9), row("d", 9, 9), row("d", 9, 9)), "k")
    assert {r.k: r.v for r in t.read().collect()} == {"a": 2, "b": 1, "c": 2, "d": 9} and t.read().count() == 4


C = config.BreakerConfig(2, 3.0, 20.0, 2.0)


def outcomes(spark, rows):
    return spark.createDataFrame([(s, T0 + dt.timedelta(seconds=t), i, ok) for s, t, i, ok in rows], "stage_id string, event_time timestamp, event_id long, ok boolean")


def plain(rows):
    step, out = folds.breaker_step(C), {}
    for s, t, i, ok in sorted(rows):
        state, _ = step(out.get(s, (None,))[0], {"ok": ok, "us": int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) + t * 1_000_000})
        out[s] = (state, t, i)
    return {s: (*x[0][:3], x[0][3], x[1], x[2]) for s, x in out.items()}


def shown(df):
    return {r.stage_id: (r.state, r.failure_count, r.trip_count, r.opened_us, int((r.updated_at - T0).total_seconds()), r.last_event_id) for r in df.collect()}


@pytest.mark.parametrize("fine", [False, True])
def test_registry_resumes(spark, tmp_path, fine):
    rng = random.Random(6)
    rows = [(rng.choice("aaab"), k // 2, k, rng.random() < 0.6) for k in range(500)] + [("late", 900, 5000, False)]
    book = BreakerRegistry(spark, str(tmp_path / "b"), C)
    assert book.load().count() == 0 and book.horizon(["a"]) is None
    if fine:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for a, z in ((0, 120), (120, 121), (0, 300), (300, 1000)):  # a batch comes again among new rows
            book.advance(outcomes(spark, [r for r in rows if a <= r[1] < z]))
            assert shown(book.load()) == plain([r for r in rows if r[1] < z])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before = shown(book.load())
    book.advance(outcomes(spark, [("a", 3, 6, False)] * 5))  # late
    assert shown(book.load()) == before


def test_registry_reads_no_history(spark, tmp_path):
    rows = [("a", k, k, k % 3 > 0) for k in range(100)]
    book = BreakerRegistry(spark, str(tmp_path / "b"), C)
    book.advance(outcomes(spark, rows))
    outcomes(spark, [*rows, ("a", 200, 200, False)]).write.parquet(str(tmp_path / "o"))
    assert book.horizon(["a"]) == T0 + dt.timedelta(seconds=99) and book.horizon(["a", "new"]) is None
    book.advance(spark.read.parquet(str(tmp_path / "o")), ["a"])
    assert shown(book.load()) == plain([*rows, ("a", 200, 200, False)])


def test_registry_of_two_writers(spark, tmp_path):
    """One that was overtaken folds again from what the other wrote."""
    a, b = (BreakerRegistry(spark, str(tmp_path / "b"), C) for _ in range(2))
    rows = [("a", k, k, k % 4 > 1) for k in range(60)]
    first = a.table.commit

    def overtaken(df, after):
        a.table.commit = first
        b.advance(outcomes(spark, rows[:40]))
        return first(df, after)

    a.table.commit = overtaken
    a.advance(outcomes(spark, rows))
    assert shown(a.load()) == plain(rows) and a.table.version() == 2


def test_registry_follows_a_stream(spark, tmp_path):
    rows = [("a", k, k, k % 5 > 1) for k in range(80)]
    for k in range(4):
        outcomes(spark, rows[20 * k : 20 * k + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    book = BreakerRegistry(spark, str(tmp_path / "b"), C)
    stream = spark.readStream.schema(outcomes(spark, []).schema).parquet(str(tmp_path / "in"))
    book.follow(stream, str(tmp_path / "ck")).awaitTermination(120)
    assert shown(book.load()) == plain(rows)


@pytest.mark.parametrize(("capped", "pane"), [(False, 512), (True, 512), (False, 4)])
def test_panes(spark, monkeypatch, capped, pane):
    from driftline.operators import panes

    monkeypatch.setattr(panes, "PANE", pane)
    rng, rows, t = random.Random(4), [], 0.0
    for k in range(400):
        t += rng.choice([0.0, 0.0, 1.0, 7.5, 29.0, 200.0])
        rows.append((rng.choice("aab"), T0 + dt.timedelta(seconds=t), rng.choice([5.0, 5.0, rng.uniform(0, 99), None]), k, 10, "ok" if k % 3 else "error", None, None))
    e = spark.createDataFrame(rows, EVENT).withColumn("event_id", F.col("row_count").cast("long"))
    c = config.WindowConfig(60.0, 1.0, 3, 5)
    got = {r.event_id: r for r in windows.at_events(e, c, capped=capped).collect()}
    assert len(got) == 400
    for k, (stage, now, *_) in enumerate(rows):
        mine = [r for r in rows if r[0] == stage and now - dt.timedelta(seconds=60) <= r[1] <= now]
        if capped:
            mine = [r for r in mine if (r[1], r[3]) <= (now, k)][-5:]
        r = got[k]
        assert r.sample_count == len(mine) and r.is_stable == (len(mine) >= 3)
        values = [x[2] for x in mine if x[2] is not None]
        if r.is_stable and values:
            assert (r.p50_latency_ms, r.p95_latency_ms, r.p99_latency_ms) == pytest.approx(tuple(np.percentile(values, (50, 95, 99))))
            assert r.mean_latency_ms == pytest.approx(np.mean(values)) and r.error_rate == pytest.approx(np.mean([x[5] != "ok" for x in mine]))
        if not r.is_stable:
            assert r.p50_latency_ms is None


@pytest.mark.parametrize("cells", [2, 16, 2048])
def test_exact_quantiles(spark, cells):
    rng = random.Random(9)
    values = {"skew": [rng.lognormvariate(0, 9) for _ in range(300)], "same": [3.25] * 50, "one": [-1.0], "ends": [-1.7e308, 1.7e308, 0.0, 5e-324, 1.0], "steps": [float(rng.randrange(4)) for _ in range(99)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    got = {r.k: r for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"low": 0.0, "mid": 0.5, "high": 0.99}, cells).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        if k != "ends":
            assert (got[k].low, got[k].mid, got[k].high) == pytest.approx(tuple(np.percentile(vs, (0, 50, 99))), rel=1e-12)
    assert got["ends"].low == -1.7e308 and got["ends"].mid == 5e-324
