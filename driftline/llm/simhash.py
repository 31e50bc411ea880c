"""SimHash fingerprints and multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. Fingerprints are linked at
max_bits or fewer differing bits, max_bits <= 2. The index has a table for each half of the fingerprint. Two
fingerprints at distance 2 or less differ in at most one bit of the upper half, or agree in the lower half; so each
probes the upper table with the 33 values of a Hamming ball of radius 1 and the lower table with its own value, and
fetched matches are verified by their complete distance. Only distinct fingerprints are indexed, each standing for all
its documents.

A bucket of more than HOT_BUCKET fingerprints would give pairs that grow with its square. Fingerprints that probe such a
bucket take another way that is just as exact: two fingerprints are within two bits if and only if the balls of radius
1 around the complete fingerprints share a point, so each emits its 65 points, and all that share a point (65 at most)
are linked to the least of them.

Defined cases: null or empty text has fingerprint zero; fewer words than a shingle: the whole sequence is one shingle;
very long texts are read whole; repeated rows return once each; rows with a null doc_id get a fingerprint and the least
doc_id of their component, null if there is none; rows that share a doc_id may lie in different components; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import few, stored, table, words_of
from driftline.llm.components import components

HOT_BUCKET = 64


def majority(h: np.ndarray) -> int:
    """Bit i is set if over half of the 64-bit hashes have it."""
    ones = np.zeros(64, "i8")
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[at : at + (1 << 14)].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype="i4")
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """words: lower-cased UTF-8. Bit i is set if over half of the shingles' hashes have it."""
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), "<u8")
    return majority(h)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            fps = [fingerprint(words_of(t, lower=True), shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, "u8").view("i8"), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _flips(value: str, bits: range) -> str:
    return ", ".join(f"{value} ^ (1L << {b})" for b in bits)


def close_pairs(fps: DataFrame, max_bits: int = 2, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (u, v) between distinct fingerprints: every pair within max_bits, or for hot buckets a star that connects
    the same fingerprints. fps: stored table with a column fp of distinct longs. With max_bits below 2 hot buckets
    emit the points at radius max_bits / 2 or less, where sharing one means distance max_bits at most; for 1 the pair
    (fp, a neighbour) is told by the points themselves."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    low, high = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"
    index = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), F.expr(e).alias("key")) for s, e in ((0, high), (1, low))))).alias("k")).select("fp", "k.*")
    size = index.groupBy("seg", "key").agg(F.count("*").alias("n"))
    crowded = stored(size.filter(F.col("n") > hot_bucket).select("seg", "key"), "simhash-crowded")
    ball = [f"array({high}, {_flips(high, range(32))})", f"array({low})"]
    probes = fps.select("fp", F.explode(F.expr(" || ".join(f"transform({b}, x -> struct({s} as seg, x as key))" for s, b in enumerate(ball)))).alias("k")).select("fp", "k.*")
    if any_crowded := not crowded.isEmpty():
        busy = stored(probes.join(crowded, ["seg", "key"], "left_semi").select("fp").distinct(), "simhash-busy")
        index, probes = index.join(crowded, ["seg", "key"], "left_anti"), probes.join(crowded, ["seg", "key"], "left_anti")
    met = probes.withColumnRenamed("fp", "u").join(index.withColumnRenamed("fp", "v"), ["seg", "key"])
    links = met.filter(f"u < v and bit_count(u ^ v) <= {max_bits}").select("u", "v")
    if any_crowded:
        own, shared = F.array(F.col("fp")), F.expr(f"array(fp, {_flips('fp', range(64))})")
        points = busy.select("fp", F.explode(own if max_bits == 0 else shared).alias("point"))
        least = points.groupBy("point").agg(F.min("fp").alias("u"), F.count("*").alias("n"))
        if max_bits == 1:  # a point that is itself a fingerprint links its neighbours
            least = least.join(busy.select(F.col("fp").alias("point")), "point", "left_semi").withColumn("u", F.col("point"))
        star = points.join(least.filter("n > 1").select("point", "u"), "point").select("u", F.col("fp").alias("v")).filter("u <> v")
        links = links.union(star)
    return links


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable over links, itself included)."""
    marks = stored(fingerprints(docs, shingle), "simhash-marks")
    classes = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    pairs = close_pairs(classes.select("fp"), max_bits)
    roots = components(pairs, "simhash-links")
    known = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    return marks.join(known.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
