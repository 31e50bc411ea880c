"""Merkle manifest of a dataset: a hash tree with FANOUT children a node over the ordered rows of each group, and one over the
groups' roots; each row gets a proof, and changed rows are told by folding their new leaf along their old proof.

Rows are ordered by range partitioning and numbered inside each group by the counts of the partitions before. A task then
holds runs of consecutive rows and reads each with a mountain-range stack: a list of open nodes for each level. When a list
reaches a multiple of FANOUT (or the level's end) it is carried: if the run saw all of the node's children, the node's
record is emitted and its digest goes up a level. Whatever a run began or ended in the middle of a node is emitted as edges,
FANOUT - 1 for each level and side at most. Edges of several runs that have one parent are merged level by level: nodes of at
most FANOUT children, so no group grows. The last node of a level has the children there are; nothing is padded.

Proofs go down the same records. Nodes FANOUT^BLOCK rows wide get the path from themselves to the root, level by level over few
rows; rows meet the records inside their node by one shuffle, in groups of FANOUT^BLOCK at most, however large a group is.

H is the hexadecimal SHA-256 of its inputs joined; digests go in as text.

Defined cases: a null value's part is '-', an empty text's '0:'; null groups come first, then groups by UTF-8 bytes; null ids
come first in their group; rows that share an id are in order of their leaves; rows that repeat all five columns have equal
leaves and each its own place and proof; a row with a null id isn't tampered with; a group of one row has its leaf as its root,
and a single group its root as the table's; very long texts are hashed whole; an empty table has no root and gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.common import dropped, guarded, stored, table

FANOUT, BLOCK = 8, 3
WIDE = 64  # characters of a digest


def joined(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def leaf(text: str | Column = "text") -> Column:
    """The leaf of a row of documents; text may be another column in place of its text."""
    c = lambda n: F.col(n).cast("string")
    part = lambda v: F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.concat(part(c("doc_id")), part(c("source")), part(c("lang")), part(c("n_chars")), part(text)), 256)


def lowered(text: str = "text") -> Column:
    """A-Z in lower case, nothing else."""
    t = F.col(text)
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def group_of(c: str) -> Column:
    """A group's name that sorts nulls first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias("grp")


def indexed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (grp, ...; stored, so that their order can be found again) with idx, their place in their group by the columns of
    order; and (grp, n, depth), depth being the levels above the leaves."""
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            grp = b.column("grp").dictionary_encode()
            code = grp.indices.to_numpy(zero_copy_only=False)
            at = np.empty(len(code), "i8")
            edge = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code)) if len(code) else [0]
            for a, z in zip(edge, edge[1:], strict=False):
                name = grp.dictionary[int(code[a])].as_py()
                seen = seen if name == last else 0
                at[a:z] = np.arange(seen, seen + z - a)
                last, seen = name, seen + int(z - a)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(code), pa.int32()), pa.array(at)], [*names, "_part", "_at"])

    dealt = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    ranked = stored(dealt.mapInArrow(number, f"{schema}, _part int, _at long"), "manifest-ranked")
    parts = ranked.groupBy("grp", "_part").agg(F.count("*").alias("n"))  # a row for each partition and group in it
    before = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = stored(parts.select("grp", "_part", "n", before.alias("_first")), "manifest-parts")
    powers = ", ".join(f"{FANOUT**k}L" for k in range(21))
    sizes = stored(parts.groupBy("grp").agg(F.sum("n").alias("n")).withColumn("depth", F.expr(f"size(filter(array({powers}), x -> x < n))")), "manifest-sizes")
    return ranked.join(guarded(parts.drop("n")), ["grp", "_part"]).select(*names, (F.col("_first") + F.col("_at")).alias("idx")), sizes


class Range:
    """The stack of one run of a group of n rows. out gets (level, at, nodes, digest): records of complete nodes, at their
    place one level up, and edges, at their own place with nodes None."""

    def __init__(self, n: int, out: list[tuple]) -> None:
        self.widths, self.out = [n], out
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // FANOUT))
        self.open: list[tuple[int, list[str]]] = [(0, [])] * len(self.widths)

    def push(self, level: int, at: int, digest: str) -> None:
        width = self.widths[level]
        if width == 1:  # the root has no parent
            return
        start, nodes = self.open[level] if self.open[level][1] else (at, [])
        nodes.append(digest)
        self.open[level] = start, nodes
        if (at + 1) % FANOUT == 0 or at + 1 == width:
            self.open[level] = 0, []
            if start % FANOUT:
                self.edges(level, start, nodes)
            else:
                text = "".join(nodes)
                up = joined(text)
                self.out.append((level, at // FANOUT, text, up))
                self.push(level + 1, at // FANOUT, up)

    def edges(self, level: int, start: int, nodes: list[str]) -> None:
        self.out += [(level, start + k, None, d) for k, d in enumerate(nodes)]

    def end(self) -> None:
        for level, (start, nodes) in enumerate(self.open):
            self.edges(level, start, nodes)


RECORD = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("nodes", pa.string()), ("digest", pa.string())])


def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (grp, n, idx, digest) in order to records and edges; any jump of grp or idx ends a run."""
    out: list[tuple] = []
    group, size, after, stack = None, 0, 0, None

    def told() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 6
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, RECORD, strict=True)], schema=RECORD)

    found: list[tuple] = []

    def move() -> None:
        out.extend((group, size, *r) for r in found)
        found.clear()

    for b in batches:
        for grp, n, idx, digest in zip(*(b.column(c).to_pylist() for c in ("grp", "n", "idx", "digest")), strict=True):
            if stack is None or grp != group or idx != after:
                if stack:
                    stack.end()
                    move()
                group, size, stack = grp, n, Range(n, found)
            stack.push(0, idx, digest)
            after = idx + 1
        move()
        yield told()
    if stack:
        stack.end()
        move()
        yield told()


def grow(rows: DataFrame, sizes: DataFrame, digest: str) -> DataFrame:
    """(grp, level, at, nodes, digest): a record for each inner node, of children at level and itself at place `at` above."""
    leaves = rows.join(guarded(sizes.select("grp", "n")), "grp").select("grp", "n", "idx", F.col(digest).alias("digest"))
    made = stored(leaves.sortWithinPartitions("grp", "idx").mapInArrow(climb, "grp string, n long, level int, at long, nodes string, digest string"), "manifest-climbed")
    records = [made.filter("nodes IS NOT NULL").select("grp", "level", "at", "nodes", "digest")]
    edges, carried = made.filter("nodes IS NULL").drop("nodes"), None
    for level in range(sizes.agg(F.max("depth")).first()[0] or 0):
        here = edges.filter(F.col("level") == level).select("grp", "n", "at", "digest")
        here = here.union(carried) if carried is not None else here
        parents = here.groupBy("grp", "n", F.expr(f"at div {FANOUT}").alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("c"))
        nodes = F.array_join(F.col("c.digest"), "")
        merged = stored(parents.select("grp", "n", F.lit(level).alias("level"), "at", nodes.alias("nodes"), F.sha2(nodes, 256).alias("digest")), "manifest-merged")
        records.append(merged.select("grp", "level", "at", "nodes", "digest"))
        carried = merged.filter(f"n > {FANOUT ** (level + 1)}").select("grp", "n", "at", "digest")
    return reduce(DataFrame.union, records)


def roots(rows: DataFrame, sizes: DataFrame, records: DataFrame, digest: str) -> DataFrame:
    """(grp, digest): a group's root; of a single row its leaf."""
    single = rows.join(guarded(sizes.filter("n = 1").select("grp")), "grp", "left_semi").select("grp", F.col(digest).alias("digest"))
    top = records.join(guarded(sizes.select("grp", (F.col("depth") - 1).alias("level"))), ["grp", "level"], "left_semi")
    return stored(single.union(top.select("grp", "digest")), "manifest-roots")


def _paths_of_blocks(sizes: DataFrame, records: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, block, path) from each node BLOCK levels up, or the root of a lower tree. above: (grp, path) from roots on.
    A path is a list of steps 'place, digests of the others'."""
    tops = sizes.select("grp", "depth").join(above, "grp").select("grp", "depth", F.lit(0).cast("long").alias("at"), "path")
    state = tops.filter(F.col("depth") > F.lit(10**6)).select("grp", "at", "path")  # none yet
    for level in reversed(range(BLOCK, sizes.agg(F.max("depth")).first()[0] or 0)):
        parents = state.union(tops.filter(F.col("depth") == level + 1).select("grp", "at", "path"))
        nodes = records.filter(F.col("level") == level).select("grp", "at", "nodes", F.explode(F.expr(f"sequence(0, length(nodes) div {WIDE} - 1)")).alias("k"))
        step = F.expr(f"concat(k, substring(nodes, 1, {WIDE} * k), substring(nodes, {WIDE} * (k + 1) + 1))")
        state = nodes.join(parents, ["grp", "at"]).select("grp", (F.col("at") * FANOUT + F.col("k")).alias("at"), F.concat(F.array(step), F.col("path")).alias("path"))
    return state.union(tops.filter(F.col("depth") <= BLOCK).select("grp", "at", "path")).select("grp", F.col("at").alias("block"), "path")


def fold(digest: str, path: list[str]) -> str:
    """The root that a leaf and its path give."""
    for step in path:
        cut = 1 + WIDE * int(step[0])
        digest = joined(step[1:cut] + digest + step[cut:])
    return digest


def proof(path: list[str]) -> str:
    return "".join(step[1:] for step in path)


def with_paths(rows: DataFrame, sizes: DataFrame, records: DataFrame, above: DataFrame, finish: Callable[[pa.Table, list[list[str]]], pa.Table], schema: str) -> DataFrame:
    """finish(rows of a block, their paths to the root of roots) for all blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, tail = {}, []
        for level, at, nodes, path in zip(*(right.column(c).to_pylist() for c in ("level", "at", "nodes", "path")), strict=True):
            if nodes is None:
                tail = path
            else:
                found[level, at] = nodes
        paths = []
        for at in left.column("idx").to_pylist():
            path = []
            for level in range(BLOCK):
                if (nodes := found.get((level, at // FANOUT))) is None:
                    break
                k = at % FANOUT
                path.append(f"{k}{nodes[: WIDE * k]}{nodes[WIDE * (k + 1) :]}")
                at //= FANOUT  # noqa: PLW2901
            paths.append(path + tail)
        return finish(left, paths)

    inner = records.filter(F.col("level") < BLOCK).select("grp", F.expr(f"at div element_at(array({', '.join(f'{FANOUT ** (BLOCK - 1 - k)}L' for k in range(BLOCK))}), level + 1)").alias("block"), "level", "at", "nodes", F.lit(None).cast("array<string>").alias("path"))
    outer = _paths_of_blocks(sizes, records, above).select("grp", "block", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("nodes"), "path")
    mine = rows.withColumn("block", F.expr(f"idx div {FANOUT**BLOCK}"))
    return mine.groupBy("grp", "block").cogroup(inner.union(outer).groupBy("grp", "block")).applyInArrow(run, schema)


class Manifest:
    """Stored: rows (grp, doc_id, leaf, tampered, idx), sizes, records (inner nodes), subroots (grp, digest), above (grp, path
    from a subroot to the root), and root, a digest or None for an empty table."""

    def __init__(self, docs: DataFrame, tampered: Column | None = None) -> None:
        leaves = docs.select(group_of("lang"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), (leaf() if tampered is None else tampered).alias("tampered"), F.monotonically_increasing_id().alias("seat"))
        leaves = stored(leaves, "manifest-leaves")
        self.rows, self.sizes = indexed(leaves, ["doc_id", "leaf", "seat"])
        self.records = grow(self.rows, self.sizes, "leaf")
        self.subroots = roots(self.rows, self.sizes, self.records, "leaf")
        # the tree over the groups: one group of their roots
        tops, size = indexed(self.subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
        over = grow(tops, size, "digest")
        self.root = (r := roots(tops, size, over, "digest").first()) and r.digest

        def name(t: pa.Table, paths: list[list[str]]) -> pa.Table:
            return pa.table({"grp": t.column("name"), "path": pa.array(paths, pa.list_(pa.string()))})

        start = size.select("grp", F.array().cast("array<string>").alias("path"))
        self.above = stored(with_paths(tops, size, over, start, name, "grp string, path array<string>"), "manifest-above")
        dropped(leaves)

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, proof (siblings' digests, from the leaf up), folded_root (from the tampered leaf)."""

        def finish(t: pa.Table, paths: list[list[str]]) -> pa.Table:
            folded = pa.array([fold(d, p) for d, p in zip(t.column("tampered").to_pylist(), paths, strict=True)], pa.string())
            return pa.table({"grp": t.column("grp"), "doc_id": t.column("doc_id"), "leaf": t.column("leaf"), "proof": pa.array(map(proof, paths), pa.string()), "folded_root": folded})

        out = with_paths(self.rows, self.sizes, self.records, self.above, finish, "grp string, doc_id long, leaf string, proof string, folded_root string")
        return out.join(guarded(self.subroots.withColumnRenamed("digest", "subroot")), "grp").drop("grp")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    m = Manifest(docs, F.when(hit, leaf(lowered())).otherwise(leaf()))
    root = F.lit(m.root).cast("string")
    return m.proofs().select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


ORACLE = r"""
WITH RECURSIVE crc AS (SELECT DISTINCT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda c, s: list_reduce(list_concat([xor(c, s)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) AS crc FROM documents WHERE doc_id IS NOT NULL),
doc AS (SELECT doc_id, lang, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents),
hashed AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS tampered
    FROM doc LEFT JOIN crc USING (doc_id)),
leaves AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
up AS (SELECT lang, 0 AS lvl, i, n, leaf AS h FROM leaves UNION ALL SELECT lang, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, lvl, i // 8, n),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
up2 AS (SELECT 0 AS lvl, i, n, subroot AS h FROM sub UNION ALL SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM up2 WHERE n > 1 GROUP BY lvl, i // 8, n),
g AS (SELECT lang, lvl, i // 8 AS p, list(h ORDER BY i) AS hs FROM up WHERE n > 1 GROUP BY ALL), g2 AS (SELECT lvl, i // 8 AS p, list(h ORDER BY i) AS hs FROM up2 WHERE n > 1 GROUP BY ALL),
go AS (SELECT id, lang, 0 AS lvl, i, n, '' AS proof, tampered AS f FROM leaves UNION ALL
    SELECT id, go.lang, go.lvl + 1, i // 8, (n + 7) // 8, proof || array_to_string(list_concat(hs[1:i % 8], hs[i % 8 + 2:]), ''), sha256(array_to_string(list_concat(list_append(hs[1:i % 8], f), hs[i % 8 + 2:]), ''))
    FROM go JOIN g ON go.lang IS NOT DISTINCT FROM g.lang AND go.lvl = g.lvl AND go.i // 8 = g.p WHERE n > 1),
go2 AS (SELECT id, 0 AS lvl, sub.i, sub.n, proof, f FROM go JOIN sub ON go.lang IS NOT DISTINCT FROM sub.lang WHERE go.n = 1 UNION ALL
    SELECT id, go2.lvl + 1, i // 8, (n + 7) // 8, proof || array_to_string(list_concat(hs[1:i % 8], hs[i % 8 + 2:]), ''), sha256(array_to_string(list_concat(list_append(hs[1:i % 8], f), hs[i % 8 + 2:]), ''))
    FROM go2 JOIN g2 ON go2.lvl = g2.lvl AND go2.i // 8 = g2.p WHERE n > 1)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified
FROM go2 JOIN leaves USING (id) JOIN sub ON leaves.lang IS NOT DISTINCT FROM sub.lang, (SELECT h FROM up2 WHERE n = 1) r WHERE go2.n = 1
"""
