"""Stored tables without MERGE: append logs with latest-wins views, guarded state changes, and paged reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.baseline import upsert
from driftline.operators.snapshots import Versions
from driftline.operators.stored import kept

__all__ = ["append_new", "current_actions", "kept", "override", "page", "record", "replay", "resolve", "swap", "upsert"]


def page(rows: DataFrame, order: list[Column], page: int = 1, size: int = 100, most: int = 1000) -> DataFrame:
    """One page: Spark keeps the first page * size rows of each task, never a full sort."""
    if page < 1 or not 1 <= size <= most:
        raise ValueError(f"page is at least 1, size 1 to {most}")
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def between(rows: DataFrame, time: str, start: str | None = None, end: str | None = None, **equal: str | None) -> DataFrame:
    """Half-open [start, end), and equality with each given value; what isn't given doesn't filter."""
    if start:
        rows = rows.filter(F.col(time) >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.filter(F.col(time) < F.lit(end).cast("timestamp"))
    for c, v in equal.items():
        if v:
            rows = rows.filter(F.col(c) == v)
    return rows


def actions_of(log: DataFrame, hypothesis_id: str) -> DataFrame:
    """All rows of one hypothesis' actions, oldest first."""
    return log.filter(F.col("hypothesis_id") == hypothesis_id).orderBy("triggered_at", "resolved_at", "id")


def audit(log: DataFrame) -> DataFrame:
    """All rows of all hypotheses' actions, by hypothesis and there as actions_of has them."""
    return log.orderBy("hypothesis_id", "triggered_at", "resolved_at", "id")


def append_new(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The rows of new whose key isn't in old."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


def record(decisions: DataFrame) -> DataFrame:
    """A pending action for each decision."""
    return decisions.select(
        F.substring(F.sha2(F.concat_ws(":", F.lit("action"), "hypothesis_id", "action").cast("binary"), 256), 1, 32).alias("id"), "hypothesis_id", F.col("target_stage_id").alias("stage_id"),
        "action", "fault_type", "severity", "rule_matched", F.lit("pending").alias("outcome"), "triggered_at", F.lit(None).cast("timestamp").alias("resolved_at"), F.lit(None).cast("string").alias("notes"),
    )


def current_actions(log: DataFrame) -> DataFrame:
    """The newest row of each action: a resolution outranks the pending row."""
    rest = [c for c in log.columns if c != "id"]
    best = F.max_by(F.struct(*rest), F.struct((F.col("outcome") != "pending").cast("int"), "resolved_at"))
    return log.groupBy("id").agg(best.alias("r")).select("id", *(f"r.{c}" for c in rest))


def resolve(log: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Rows to append for resolutions (id, outcome, resolved_at, notes): only pending actions can be resolved."""
    now = current_actions(log).filter("outcome = 'pending'").drop("outcome", "resolved_at", "notes")
    return now.join(resolutions, "id").select(*log.columns)


def override(log: DataFrame, hypothesis_id: str, at: Column, by: str) -> DataFrame:
    """The row to append that cancels a hypothesis' newest action. LookupError without one, ValueError if it isn't pending."""
    newest = current_actions(log).filter(F.col("hypothesis_id") == hypothesis_id).orderBy(F.desc("triggered_at"), F.desc("id")).limit(1)
    found = newest.collect()
    if not found:
        raise LookupError(hypothesis_id)
    if found[0].outcome != "pending":
        raise ValueError(f"action is {found[0].outcome}")
    return newest.withColumn("outcome", F.lit("cancelled")).withColumn("resolved_at", at).withColumn("notes", F.concat(F.lit("override: "), F.lit(by)))


def replay(log: DataFrame, partition: int, start_offset: int, end_offset: int) -> DataFrame:
    """Messages of an offset range (both ends count), marked as replayed; the originals stay."""
    return log.filter((F.col("partition") == partition) & F.col("offset").between(start_offset, end_offset)).withColumn("replayed", F.lit(True))


def swap(df: DataFrame, path: str) -> int:
    """A new version of a table (see snapshots), whatever was there: a reader sees the old or the new whole."""
    return Versions(df.sparkSession, path).update(lambda _: df)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    return Versions(spark, path).read()
