"""Quality classifier: logistic regression over hashed word 1-grams and 2-grams.

Words are runs without the six ASCII white-space characters, lower-cased (A-Z). A word equal to the one before becomes
one common token and so do words with a digit, so repetition and numbers count whichever word shows them; 2-grams are
taken over these tokens. Features are binary and scaled to length one. SAMPLE bounds the labelled rows that are fitted
(the first by a hash of doc_id); all texts are scored whole.

Defined cases: null or empty text scores the bias alone; very long texts are read whole; rows without a label, or with a null
one, aren't fitted; a document labelled twice with different labels counts as good; of rows that share a doc_id the one with
the least text is fitted, and each is scored; a null doc_id is scored, never fitted; no labels: every score is 0.5; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import table, words_of
from driftline.llm.linear import bounded, hashes, one_each, remainder, score, slots, train

SAMPLE = 16_000
SAME, NUMBER = np.uint64(0xA5A5_1111_0000_0001), np.uint64(0xA5A5_1111_0000_0002)
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
DIGITS = frozenset(b"0123456789")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(text, lower=True)
    h = hashes(words)
    raw = h.copy()
    h[np.fromiter((not DIGITS.isdisjoint(w) for w in words), bool, len(words))] = NUMBER
    h[1:][raw[1:] == raw[:-1]] = SAME
    at = np.unique(slots(np.concatenate([h, h[:-1] * LEFT + h[1:] * RIGHT])))
    x = np.full(len(at) + 1, 1 / np.sqrt(max(1, len(at))), "f4")
    x[0] = 1
    return np.concatenate([np.zeros(1, "i4"), at]), x


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = SAMPLE) -> np.ndarray:
    """learn: which labelled rows may be fitted. At most limit of them are, so their ids are broadcast."""
    chosen = bounded(labels.filter(learn & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y")), limit)
    return train(one_each(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")), features, epochs=5, alpha=2.0, l1=0.1)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    scored = score(docs, model, features)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
