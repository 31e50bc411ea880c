"""Sparse logistic regression on hashed features, trained with follow-the-regularised-leader updates.

Models are fitted on a bounded sample in one task (the caller states the bound); scoring is a sparse dot product for
every document. Feature 0 is the bias.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import few

BITS = 18
Features = Callable[[str | None], tuple[np.ndarray, np.ndarray]]


def hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "<u8")


def slots(h: np.ndarray) -> np.ndarray:
    """Hashes to feature numbers 1 .. 2^BITS - 1."""
    return (h % np.uint64((1 << BITS) - 1)).astype("i4") + 1


def fit(examples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int, alpha: float, l1: float, l2: float, beta: float = 1.0) -> np.ndarray:
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in examples:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            old = n[at]
            z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
            n[at] = old + g * g
    return weights(slice(None)).astype("f4")


def train(sample: DataFrame, features: Features, epochs: int = 4, alpha: float = 0.5, l1: float = 0.5, l2: float = 1e-3) -> np.ndarray:
    """sample: (doc_id, text, y double), at most as many rows as its caller's documented bound. Features are made where
    the rows are; one task runs the updates in an order set by doc_id. No rows: all weights are zero."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i.as_py(), *(a.tobytes() for a in features(t.as_py())), y.as_py()) for i, t, y in zip(b["doc_id"], b["text"], b["y"], strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "at", "x", "y"), r, strict=True)) for r in out], pa.schema([("doc_id", pa.int64()), ("at", pa.binary()), ("x", pa.binary()), ("y", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["at"], r["y"]))
        model = fit([(np.frombuffer(r["at"], "i4"), np.frombuffer(r["x"], "f4"), r["y"]) for r in rows], epochs, alpha, l1, l2)
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], ["model"])

    made = sample.select("doc_id", "text", F.col("y").cast("double")).mapInArrow(extract, "doc_id long, at binary, x binary, y double")
    found = made.repartition(1).mapInArrow(run, "model binary").collect()  # one row of 2^BITS floats
    return np.frombuffer(found[0].model, "f4") if found else np.zeros(1 << BITS, "f4")


def score(docs: DataFrame, model: np.ndarray, features: Features, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, extra columns, score double."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in few(batches):
            dots = [float(w[at] @ x) for at, x in (features(t) for t in b.column("text").to_pylist())]
            p = 1 / (1 + np.exp(-np.clip(np.array(dots, "f8"), -35, 35)))
            keep = [b.column(c) for c in ("doc_id", *extra)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(p, pa.float64())], ["doc_id", *extra, "score"])

    kept = docs.select(F.col("doc_id").cast("long"), *extra, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    return kept.mapInArrow(run, f"{schema}, score double")


def keep_below(docs: DataFrame, model: np.ndarray, features: Features, limit: float) -> DataFrame:
    """The documents, with all their columns, that score below limit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    edge = float(np.log(limit / (1 - limit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            yield b.filter(pa.array([float(shared.value[at] @ x) < edge for at, x in map(features, b.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def one_each(sample: DataFrame) -> DataFrame:
    """One row (doc_id, text, y) for each doc_id of a bounded sample, however often the documents repeat it: the least text, the largest y."""
    return sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """At most limit rows, chosen by a hash of doc_id."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
