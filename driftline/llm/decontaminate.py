"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides hash their GRAM-word grams and keep the least hash of every WINDOW consecutive words. The least hash depends
on the window's words alone, so a benchmark window that occurs in a document leaves the same fingerprint on both
sides: every shared span of WINDOW words is found. Documents' fingerprints are semi-joined with the benchmark's; at the
hits that survive, the surrounding windows are extended to all their words and joined exactly, and the covered words
are merged. Benchmark items shorter than a window are one window of their own length, which has no fingerprint of WINDOW words:
every place is tried whose hash is in a bitmap of SLOTS longs of such items' hashes, so only places that may match become rows.

The benchmark's fingerprints and windows are broadcast only if their measured bytes fit a bound; otherwise they meet the
documents' by shuffle, where the skew join splits frequent ones.

Defined cases: null or empty text has no words and no hits; very long texts are read whole, in one row; an empty benchmark
hits nothing; null items have no windows; items with equal texts count each; rows are told apart by doc_id (null too) and
text, so rows that share a doc_id but not the text are documents of their own, and rows that repeat both are one; windows
that hit at one place count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import guarded, stored, table, wide_key

WINDOW, GRAM = 10, 5
SLOTS = 4096
APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: str = "text") -> Column:
    """Lower-cased (A-Z) runs of ASCII letters, digits and all other characters beyond ASCII."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, APART), "")


def least_hashes(w: Column, window: int = WINDOW, gram: int = GRAM) -> tuple[Column, Column]:
    """Columns to be selected one after the other: gram hashes, and from the column _h the least of each window."""
    h = F.when(F.size(w) >= window, F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, gram)))))
    col = F.col("_h")
    least = F.transform(F.slice(col, F.lit(1), F.size(col) - (window - 1)), lambda x, i: F.least(x, *(F.get(col, i + k) for k in range(1, window - gram + 1))))
    return h, least


def winnowed(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """rows with a column _w of words: adds _m, the least gram hash of the window that starts at each word."""
    h, least = least_hashes(F.col("_w"), window)
    return rows.withColumn("_h", h).withColumn("_m", least).drop("_h")


def text_of(w: Column, start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(w, start + 1, length), " ")


def run_hash(w: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(w, i + k) for k in range(n)))


def bit_of(h: Column) -> tuple[Column, Column]:
    """Slot and bit of a hash in the bitmap."""
    return F.pmod(h, F.lit(SLOTS)), F.shiftrightunsigned(h, 48).bitwiseAND(63).cast("int")


def bitmap(hashes: DataFrame) -> DataFrame:
    """One row with a column _bits: SLOTS longs. hashes: a column h."""
    slot, bit = bit_of(F.col("h"))
    set_bits = hashes.select(slot.alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    return hashes.sparkSession.range(SLOTS).join(set_bits, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("l")).select(F.col("l.bits").alias("_bits"))


def likely_places(w: Column, n: int) -> Column:
    """Windows of n words whose hash is in the bitmap _bits; NULL for shorter texts."""
    def may(i: Column) -> Column:
        slot, bit = bit_of(run_hash(w, i, n))
        return F.call_function("shiftright", F.get("_bits", slot.cast("int")), bit).bitwiseAND(1) == 1

    place = lambda i: F.struct(i.alias("start"), F.lit(n).alias("len"), text_of(w, i, n).alias("words"))
    return F.when(F.size(w) >= n, F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - n), may), place))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """row (tells documents apart), doc_id, n_words, spans (array of start and length of covered word windows), items (sorted ids as strings)."""
    w = F.col("_w")
    tests = winnowed(benchmark.select(F.col("item_id").cast("string"), words().alias("_w")).filter(F.size("_w") > 0))
    long = tests.filter(F.size(w) >= window)
    windows = long.select("item_id", F.explode(F.transform("_m", lambda m, i: F.struct(text_of(w, i, window).alias("words"), F.lit(window).alias("len")))).alias("x"))
    short = tests.filter(F.size(w) < window).select("item_id", F.struct(F.array_join(w, " ").alias("words"), F.size(w).alias("len")).alias("x"))
    spans = stored(windows.union(short).select("item_id", "x.*").distinct(), "winnow-windows")
    marks = guarded(stored(long.select(F.explode(F.array_distinct("_m")).alias("mark")).distinct(), "winnow-marks"))
    lengths = [r.len for r in spans.filter(F.col("len") < window).select("len").distinct().collect()]  # below window
    texts = docs.select(wide_key().alias("row"), F.col("doc_id").cast("long"), words().alias("_w"))
    found = winnowed(texts).select("row", F.explode(F.array_distinct("_m")).alias("mark")).join(marks, "mark", "left_semi")
    hits = guarded(stored(found.groupBy("row").agg(F.collect_set("mark").alias("_marks")), "winnow-hits"))
    h, least = least_hashes(w, window)
    near = texts.join(hits, "row", "left").withColumn("_h", F.when(F.col("_marks").isNotNull(), h)).withColumn("_m", least)
    starts = F.filter(F.transform("_m", lambda m, i: F.when(F.array_contains("_marks", m), i)), lambda i: i.isNotNull())
    tries = F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(window).alias("len"), text_of(w, i, window).alias("words")))
    near = near.withColumn("_t", F.coalesce(tries, F.array().cast("array<struct<start:int,len:int,words:string>>")))
    if lengths:
        own = spans.filter(F.col("len") < window).select(F.split("words", " ").alias("_w"))
        of_length = [F.when(F.size(w) == n, run_hash(w, F.lit(0), n)) for n in lengths]
        near = near.join(F.broadcast(bitmap(own.select(F.coalesce(*of_length).alias("h")))))  # one row of fixed size
    for n in sorted(lengths):
        near = near.withColumn("_t", F.concat("_t", F.coalesce(likely_places(w, n), F.array().cast("array<struct<start:int,len:int,words:string>>"))))
    counts = near.select("row", "doc_id", F.size(w).cast("long").alias("n_words"), F.explode_outer("_t").alias("t")).select("row", "doc_id", "n_words", "t.*")
    met = counts.join(guarded(spans), ["words", "len"], "left").withColumn("hit", F.col("item_id").isNotNull())
    return met.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(F.when(F.col("hit"), F.struct("start", "len")))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items")
    )


def covered(spans: str | Column) -> Column:
    """Words under sorted (start, len) windows."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["start"] + s["len"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("n_hit", covered("spans"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
