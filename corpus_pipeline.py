"""A corpus pipeline of five operators: each stage reads the documents that the one before kept, as Parquet.

toxicity       documents that score 0.5 or more are dropped (the model learns from all labels)
near_dedup     one document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more, directly or
               over others) stays, the one with the least doc_id, then the least digest of its text. SimHash's index links
               those within two bits; a prefix join finds the near copies that lie farther apart
suffix_dedup   bytes under strings of 200 bytes that occur elsewhere are cut, to whole characters; documents of which
               nothing is left are dropped
decontaminate  documents with a passage of the benchmark are dropped
packing        the rest is tokenised and packed into sequences

All stages but the last return the columns of documents, and leave what they keep as it is (suffix_dedup sets text and,
where there is one, n_chars).

Defined cases: null text counts as empty; empty documents are near copies of each other, so one stays, if suffix_dedup
leaves it: it drops only documents that it empties; very long texts are read whole in every stage; rows are told apart by
doc_id (null too) and text; of rows that repeat both, the least by all columns stays; a null doc_id comes last among the
near copies that may stay; empty tables give empty results; without labels no document is toxic, without benchmark none is
contaminated; further columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontaminate, near_copies, packing, suffixes, toxicity
from driftline.llm.common import few, guarded, row_key, stored, table, unpack_spans, wide_key, with_spans
from driftline.llm.linear import keep_below

SPANS, ID, TEXT, ROW = (f"__corpus_pipeline_{x}__" for x in ("spans", "id", "text", "row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return keep_below(docs, model, toxicity.features, 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = stored(near_copies.near_copies(docs.select("doc_id", "text")), "pipeline-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    heads = groups.groupBy("component").agg(F.min(order).alias("head"))
    gone = groups.join(heads, "component").filter(order != F.col("head"))
    gone = guarded(stored(gone.select(F.col("doc_id").alias(ID), F.col("digest").alias(TEXT)).distinct(), "pipeline-copies"))
    again = groups.groupBy(F.col("doc_id").alias(ID), F.col("digest").alias(TEXT)).agg(F.count("*").alias("n")).filter("n > 1")
    again = stored(again.select(ID, TEXT), "pipeline-repeated")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(ID)) & (near_copies.text_digest() == F.col(TEXT))
    left = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return left
    again = guarded(again)
    # of rows with one doc_id and text, the least by all columns
    one = left.join(again, same).groupBy(ID, TEXT).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.join(again, same, "left_anti").unionByName(one).select(*docs.columns)


def whole_characters(data: bytes, a: np.ndarray, z: np.ndarray) -> list[tuple[int, int]]:
    """Spans shrunk to the characters that lie wholly inside."""
    out = []
    for s, e in zip(a.tolist(), z.tolist(), strict=True):
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while s < e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        out.append((s, e))
    return out


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = suffixes.repeats(docs.select(row_key().alias("doc_id"), "text"))
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            texts, keep = b.column("text").to_pylist(), []
            for k, s in enumerate(b.column(SPANS).to_pylist()):
                if s is not None:
                    data = texts[k].encode()
                    edge = [0, *(x for pair in whole_characters(data, *unpack_spans(s)) for x in pair), len(data)]
                    texts[k] = b"".join(data[x:y] for x, y in zip(edge[::2], edge[1::2], strict=True)).decode()
                keep.append(s is None or bool(texts[k]))
            cols = {c: b.column(c) for c in names} | {"text": pa.array(texts, b.column("text").type)}
            yield pa.RecordBatch.from_pydict(cols).filter(pa.array(keep, pa.bool_()))

    spans = spans.select(F.col("doc_id").alias(ROW), F.col("spans").alias(SPANS))
    marked = with_spans(docs.withColumn(ROW, row_key()), spans, ROW).select(*names, SPANS)
    out = marked.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marks = decontaminate.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    gone = guarded(stored(marks.filter(F.size("spans") > 0).select(F.col("row").alias(ROW)), "pipeline-contaminated"))
    return docs.join(gone, wide_key() == F.col(ROW), "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(stored(packing.pieces(docs), "pipeline-pieces"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_repeats), ("decontaminate", drop_contaminated), ("packing", pack)]
#: No stage but decontamination has an SQL form; tests/llm hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
