"""Consistent-hash ring with virtual nodes and bounded loads.

Every key hashes to one of CELLS cells of a ring; each shard owns several virtual nodes, each in a cell of its own. A
key's home is the first virtual node at or clockwise after its cell. Shard capacities are set beforehand; keys that find
their shard full continue clockwise to the next virtual node whose shard has room. All keys of a cell share one
clockwise route, so who overflows to where is settled on counts for each cell: CELLS integers, whatever the table's
size. Rows then look their place up by rank inside their cell. Ranks are counted in two steps: each cell's rows are
dealt to PARTS parts by a hash of the whole row and its place in the stored table, ranked there, and moved up by the counts of
the parts before, so a key with a third of all rows spreads over PARTS tasks.

With load_factor 1 the capacities are floor or ceil of rows / shards and add up to the rows: counts differ by at most
one (law "rows"). A larger factor leaves room: shard sizes are bounded by ceil(load_factor * rows / shards) and fewer
keys leave their home, so fewer move when a shard is added.

Defined cases: a null key hashes like any other value; rows with equal keys share a cell, in any order; repeated rows are
placed once each; an empty table gives an empty result; null text has size 16 and checksum 0; very long texts count by
their bytes; other columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.common import guarded, stored, table

CELLS = 1 << 14
PARTS = 64
VNODES = 64


def cell_of(*cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(CELLS)).cast("int")


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """Virtual nodes as (cell, shard) in ring order; a taken cell passes a node on to the next free one."""
    if shards * vnodes > CELLS // 2:
        raise ValueError(f"at most {CELLS // 2} virtual nodes")
    # a shard's nodes have the same numbers, so the same cells, however many shards follow
    nodes = spark.range(shards * vnodes).select(F.floor(F.col("id") / vnodes).cast("int").alias("shard"), F.col("id"))
    taken: dict[int, int] = {}
    for r in nodes.select("shard", "id", cell_of(F.lit("node"), "id").alias("cell")).orderBy("id").collect():
        cell = r.cell
        while cell in taken:
            cell = (cell + 1) % CELLS
        taken[cell] = r.shard
    return sorted(taken.items())


def place(counts: dict[int, int], nodes: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (cell, first rank, end rank, shard, first slot): a cell's keys by rank, in the order of their acceptance."""
    room, filled = list(capacity), [0] * len(capacity)
    cells = [c for c, _ in nodes]
    waiting = [(c, 0, n, bisect_left(cells, c) % len(nodes)) for c, n in sorted(counts.items()) if n]
    pieces = []
    while waiting:  # each round every group with keys left asks one shard; own homes come first
        left = []
        for cell, rank, end, at in waiting:
            shard = nodes[at][1]
            if got := min(room[shard], end - rank):
                pieces.append((cell, rank, rank + got, shard, filled[shard]))
                room[shard] -= got
                filled[shard] += got
            if rank + got < end:
                left.append((cell, rank + got, end, at))
        waiting = []
        for cell, rank, end, at in left:
            for step in range(1, len(nodes) + 1):
                if room[nodes[nxt := (at + step) % len(nodes)][1]]:
                    break
            else:
                raise ValueError("the capacities are smaller than the rows")
            waiting.append((cell, rank, end, nxt))
    return pieces


def assign(rows: DataFrame, key: str, shards: int, vnodes: int = VNODES, load_factor: float = 1.0) -> DataFrame:
    """rows with shard and slot (gapless from 0 in each shard)."""
    spark = rows.sparkSession
    names = rows.columns
    rows = stored(rows.withColumn("_cell", cell_of(key)).withColumn("_part", F.pmod(F.xxhash64(*names, F.monotonically_increasing_id()), F.lit(PARTS)).cast("int")), "ring-rows")
    parts = rows.groupBy("_cell", "_part").agg(F.count("*").alias("n"))  # CELLS * PARTS rows at most
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = stored(parts.select("_cell", "_part", "n", before.alias("_first")), "ring-parts")
    counts = {r.cell: r.n for r in first.groupBy(F.col("_cell").alias("cell")).agg(F.sum("n").alias("n")).collect()}  # CELLS at most
    total = sum(counts.values())
    if load_factor <= 1:
        capacity = [total // shards + (s < total % shards) for s in range(shards)]
    else:
        capacity = [-int(-load_factor * total // shards)] * shards
    pieces = place(counts, ring(spark, shards, vnodes), capacity)
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([dict(zip(("c", "lo", "hi", "s", "at"), p, strict=True)) for p in pieces])), "array<struct<c:int,lo:bigint,hi:bigint,s:int,at:bigint>>")).alias("p")).select("p.*")
    here = F.row_number().over(Window.partitionBy("_cell", "_part").orderBy(F.xxhash64(*names)))
    ranked = rows.withColumn("_here", here).join(guarded(first.drop("n")), ["_cell", "_part"]).withColumn("_rank", F.col("_first") + F.col("_here") - 1)
    # plan: at most a piece a cell and one more for each shard that fills up, so its size is bounded by the ring
    on = (F.col("_cell") == F.col("c")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    return ranked.join(F.broadcast(plan), on).select(*names, F.col("s").alias("shard"), (F.col("at") + F.col("_rank") - F.col("lo")).alias("slot"))


def op9_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign(rows, "doc_id", 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
