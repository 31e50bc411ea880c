"""Substring dedup with fixed-block anchors.

Reference blocks of BLOCK words lie at every BLOCK-th word of each document, without overlap. A window of 2 * BLOCK - 1
words covers at least one whole block wherever it starts, so any repeated window shows when all rolling windows of BLOCK
words probe the index of blocks. Blocks and probes are dealt by hash; a probe that meets a block of another document
marks both places, and the words around them are the only ones looked at again: marked places are extended to all windows
around them, equal windows are found by their complete hash, and neighbouring hits merge into maximal exact repeats.

Probes travel as packed arrays, five or six bytes each, one row for a bucket of hashes and a batch of documents. They name
the batch and the place in it, so their size doesn't grow with the number of buckets; each batch's table of documents
travels once, to where the marked places of the batch are gathered. Documents start at multiples of BLOCK in a batch, so a
block is a probe at a multiple of BLOCK and needs no row of its own. Exact copies of a text are settled first, and only
the first document of each goes on. A gram that meets a block inside its batch is marked there, and only its first place
and its first block go on, so no bucket gathers all occurrences of a common line; so is one that comes more than FREQUENT
times (which marks more places to look at, never fewer). Marked places are found by 64-bit hashes; windows are compared by 128
bits, two mixes of two independent hashes of each word.

Defined cases: null or empty text has no words; very long texts are read whole; a window never repeats inside its own doc_id;
rows that share a doc_id but not the text are told apart, and neither is earlier than the other; of rows with the same doc_id
and text each is returned with the same result; a null doc_id is neither smaller nor larger than another, so its words
stay and remove none; of documents that share a window all but the one with the least doc_id lose it; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import WHOLE, byte_size, few, guarded, merge, mix, numbered, pack_spans, small_batches, stored, table, unpack_spans, with_spans, words_of

WORDS = 13
BATCH, FREQUENT = 1 << 20, 256
BUCKET_BYTES = 6 << 20  # of text
ODD = np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1 for k in range(1, 65)], "u8")


def word_hashes(text: str | None) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words_of(text)), "u8")


def wide_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words_of(text))), ">u8").astype("u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, "u8")
    out = h[:m] * ODD[0]
    for k in range(1, n):
        out = out + h[k : k + m] * ODD[k]
    return mix(out)


def planes(a: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned integers, byte by byte, so that a codec sees the zeros together."""
    return np.ascontiguousarray(a.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), "u1")
    out[:, :width] = np.frombuffer(data, "u1").reshape(width, -1).T
    return out.view("<u8").ravel()


PACKED = "part int, h binary, docs binary, runs binary, pos binary"
NAMES = ("part", "h", "docs", "runs", "pos")
NAMED = b"n"  # in h: a table of a batch (in pos) with its documents and their first places (in runs)


def shipped(part: np.ndarray, doc: np.ndarray, pos: np.ndarray, h: np.ndarray | None = None, width: int = 0, more: np.ndarray | None = None) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """Packed rows, one for each part: hashes (their low bytes; all of `more` after those of h), documents (or batches), entries for each, differences of positions."""
    order = np.argsort(part, kind="stable")
    doc, pos, part = doc[order], pos[order], part[order]
    edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, int)
    for a, z in zip(edge, edge[1:], strict=False):
        d = doc[a:z]
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        yield int(part[a]), (planes(h[order[a:z]], width) if width else b"") + (planes(more[order[a:z]], 8) if more is not None else b""), d[first].astype("<i8").tobytes(), planes(np.diff(np.append(first, z - a)), 4), planes(np.diff(pos[a:z], prepend=0), 4)


def opened_wide(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """opened() of rows with two hashes of 8 bytes."""
    halves = [(x.as_py()[: len(x.as_py()) // 2], x.as_py()[len(x.as_py()) // 2 :]) for x in t.column("h")]
    _, doc, pos = opened(t)
    h, more = (np.concatenate([unplanes(x[k], 8) for x in halves]) if halves else np.zeros(0, "u8") for k in (0, 1))
    return h, more, doc, pos


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.binary()] * 4), strict=True)], list(NAMES))


def opened(t: pa.Table, width: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, docs, runs, pos = ([x.as_py() for x in t.column(c)] for c in NAMES[1:])
    if not docs:
        return np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    doc = np.concatenate([np.repeat(np.frombuffer(d, "<i8"), unplanes(r, 4).astype("i8")) for d, r in zip(docs, runs, strict=True)])
    return np.concatenate([unplanes(x, width) for x in h]) if width else np.zeros(0, "u8"), doc, np.concatenate([np.cumsum(unplanes(x, 4)) & np.uint64(WHOLE) for x in pos]).astype("i8")


def dealt_documents(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mix(doc.astype("u8")) % np.uint64(groups)).astype("i4")


def probes(docs: DataFrame, buckets: int, block: int, least_words: int) -> DataFrame:
    """Packed rolling grams by bucket, of batches; part -1: places that are marked already, -2: tables of documents."""

    def flush(parts: list[tuple[int, np.ndarray]], batch: int) -> pa.RecordBatch:
        sizes = np.array([len(g) for _, g in parts])
        first = np.cumsum(np.append(0, -(-sizes // block) * block))[:-1]
        h = np.concatenate([g for _, g in parts])
        pos = np.concatenate([np.arange(f, f + n) for f, n in zip(first, sizes, strict=True)])
        doc = np.full(len(h), batch, "i8")
        bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype("i4")
        order = np.argsort(h, kind="stable")
        hs = h[order]
        first_of = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
        count = np.diff(np.append(first_of, len(hs)))
        anchor = np.minimum.reduceat(np.where(pos[order] % block == 0, np.arange(len(hs)), len(hs)), first_of)  # its first block
        settled = (count > FREQUENT) | (count > 1) & (anchor < len(hs))
        marks = np.repeat(settled, count)
        leave = marks.copy()
        leave[first_of] = False
        leave[anchor[settled & (anchor < len(hs))]] = False
        often, drop = np.empty(len(h), bool), np.empty(len(h), bool)
        often[order], drop[order] = marks, leave
        rest = shipped(np.full(often.sum(), -1, "i4"), doc[often], pos[often])
        named = (-2, NAMED, np.array([d for d, _ in parts], "<i8").tobytes(), first.astype("<u4").tobytes(), int(batch).to_bytes(8, "little"))
        return packed_batch([*shipped(bucket[~drop], doc[~drop], pos[~drop], h[~drop], 4), *rest, named])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, batch = [], 0, TaskContext.get().partitionId() << 32
        for b in few(batches):
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                h = word_hashes(t)
                if len(h) >= least_words:
                    g = grams(h, block)
                    parts.append((d, g))
                    size += len(g)
                    if size >= BATCH:
                        yield flush(parts, batch)
                        parts, size, batch = [], 0, batch + 1
        if parts:
            yield flush(parts, batch)

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def places(doc: np.ndarray, start: np.ndarray, end: np.ndarray, ids: str = "doc_id") -> pa.Table:
    """(doc_id, spans): intervals of each document, merged."""
    order = np.argsort(doc, kind="stable")
    doc, start, end = doc[order], start[order], end[order]
    edge = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)) if len(doc) else np.zeros(1, int)
    spans = [pack_spans(*merge(start[a:z], end[a:z])) for a, z in zip(edge, edge[1:], strict=False)]
    return pa.table({ids: pa.array(doc[edge[:-1]], pa.int64()), "spans": pa.array(spans, pa.binary())})


def union_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, spans) with one row for each document; its parts are at most as long as the document."""

    return rows.groupBy("doc_id").agg(F.collect_list("spans").alias("l")).mapInArrow(lambda bs: (joined(b) for b in bs), "doc_id long, spans binary")


def joined(b: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for parts in b.column("l").to_pylist():
        both = [unpack_spans(x) for x in parts]
        out.append(pack_spans(*merge(np.concatenate([a for a, _ in both]), np.concatenate([z for _, z in both]))))
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "spans"])


def marked(sent: DataFrame, block: int, groups: int) -> DataFrame:
    """(doc_id, spans): places of probes and blocks that meet. Repeats inside a document are among them; they cost a look
    at their windows, which tells them apart."""

    def meet(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        if part == -2:
            to = dealt_documents(np.frombuffer(b"".join(x.as_py() for x in t.column("pos")), "<i8"), groups)
            return t.select(NAMES).set_column(0, "part", pa.array(to, pa.int32()))
        if part == -1:
            _, doc, pos = opened(t)
            return pa.Table.from_batches([packed_batch(list(shipped(dealt_documents(doc, groups), doc, pos)))])
        h, doc, pos = opened(t, 4)
        order = np.argsort(h, kind="stable")
        hs, p = h[order], pos[order]
        first = np.append(True, hs[1:] != hs[:-1])
        group, at = np.cumsum(first) - 1, np.flatnonzero(first)
        more = np.diff(np.append(at, len(h))) > 1
        keep = (more & (np.maximum.reduceat((p % block == 0).astype("u1"), at) > 0))[group]
        back = order[keep]
        back.sort()  # in the order of batches again
        return pa.Table.from_batches([packed_batch(list(shipped(dealt_documents(doc[back], groups), doc[back], pos[back])))])

    def gather(t: pa.Table) -> pa.Table:
        named = pc.equal(t.column("h"), NAMED)
        _, batch, at = opened(t.filter(pc.invert(named)))
        order = np.argsort(batch, kind="stable")
        batch, at = batch[order], at[order]
        doc, start = np.zeros(len(at), "i8"), np.zeros(len(at), "i8")
        for ids, first, b in zip(*(t.filter(named).column(c).to_pylist() for c in ("docs", "runs", "pos")), strict=True):
            a, z = np.searchsorted(batch, int.from_bytes(b, "little") + np.arange(2))
            first = np.frombuffer(first, "<u4").astype("i8")
            k = np.searchsorted(first, at[a:z], side="right") - 1
            doc[a:z], start[a:z] = np.frombuffer(ids, "<i8")[k], at[a:z] - first[k]
        return places(doc, start, start + 1)

    salt = F.when(F.col("part") < 0, F.xxhash64("docs", "pos")).otherwise(F.lit(0))  # marked places need no meeting
    return sent.withColumn("salt", salt).groupBy("part", "salt").applyInArrow(meet, PACKED).groupBy("part").applyInArrow(gather, "doc_id long, spans binary")


def by_document(packed: DataFrame, length: int) -> DataFrame:
    """(doc_id, spans) of packed places that were dealt by document; each place covers length words."""

    def gather(t: pa.Table) -> pa.Table:
        _, doc, pos = opened(t)
        return places(doc, pos, pos + length)

    return packed.groupBy("part").applyInArrow(gather, "doc_id long, spans binary")


def text_digest() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def named(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text) with a column row for repeats(), null for a null doc_id, and the number of its low bits that tell texts of
    one doc_id apart. Where each doc_id has one text, row is doc_id. Else texts (by SHA-256) of a doc_id are numbered; where
    ids and these numbers don't fit in 63 bits together, ids are replaced by their rank."""
    told = docs.filter("doc_id IS NOT NULL").select("doc_id", text_digest().alias("digest")).groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b")
    several = stored(told.select("doc_id"), "blocks-shared")
    if several.isEmpty():
        return docs.withColumn("row", F.col("doc_id")), 0
    texts = docs.select("doc_id", text_digest().alias("digest")).join(guarded(several), "doc_id", "left_semi").distinct()
    order = numbered(stored(texts, "blocks-texts"), ["doc_id", "digest"], "k")
    first = order.groupBy("doc_id").agg(F.min("k").alias("first"))
    names = stored(order.join(first, "doc_id").select(F.col("doc_id").alias("shared"), F.col("digest").alias("same"), (F.col("k") - F.col("first")).alias("k")), "blocks-names")
    bits = int(names.agg(F.max("k")).first()[0]).bit_length()
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    own = docs.withColumn("_id", F.col("doc_id"))
    if least < -(1 << (62 - bits)) or most >= 1 << (62 - bits):
        ranks = numbered(stored(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("ranked")).distinct(), "blocks-ids"), ["ranked"], "rank")
        ranks = stored(ranks, "blocks-ranks")
        if ranks.count() >= 1 << (62 - bits):
            raise ValueError("more ids, and texts of one id, than 62 bits number")
        own = own.join(guarded(ranks), F.col("doc_id") == F.col("ranked"), "left").withColumn("_id", F.col("rank"))
    met = own.join(guarded(names), (F.col("doc_id") == F.col("shared")) & (text_digest() == F.col("same")), "left")
    return met.select(*docs.columns, (F.shiftleft("_id", bits) + F.coalesce("k", F.lit(0))).alias("row")), bits


def repeats(docs: DataFrame, words: int = WORDS, bits: int = 0) -> DataFrame:
    """(doc_id, spans): maximal runs of words that are covered by windows which also start in an earlier document.
    docs: (doc_id, text), doc_id the name that named() gives; one is earlier than another by its bits above the low `bits`."""
    block = (words + 1) // 2
    buckets = max(1, byte_size(small_batches(docs)) // BUCKET_BYTES + 1)
    digest = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.octet_length("text").alias("size"))
    copies = digest.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.max("size").alias("size")).filter("rep < last and size > 0")
    later = stored(digest.join(copies.select("digest", "rep"), "digest").filter("doc_id > rep").select("doc_id").distinct(), "blocks-copies")
    alone = docs.join(guarded(later), "doc_id", "left_anti")
    near = stored(marked(probes(alone, buckets, block, words), block, buckets), "blocks-places")  # one row for each document

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in few(batches):
            for d, t, s in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                g, more = (grams(h, words) for h in wide_hashes(t))
                a, z = unpack_spans(s)
                a, z = merge(np.maximum(a - (words - block), 0), np.minimum(z, len(g)))
                i = np.concatenate([np.arange(x, y) for x, y in zip(a, z, strict=True)])
                held.append((np.full(len(i), d, "i8"), g[i], more[i], i))
                size += len(i)
                if size >= BATCH:
                    yield settle(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield settle(*map(np.concatenate, zip(*held, strict=True)))

    def later_than(h: np.ndarray, more: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which entries have equal hashes in an earlier document among these."""
        doc = doc >> bits
        order = np.lexsort((more, h))
        hs, ms = h[order], more[order]
        first = np.append(True, (hs[1:] != hs[:-1]) | (ms[1:] != ms[:-1]))
        out = np.empty(len(h), bool)
        out[order] = doc[order] > np.minimum.reduceat(doc[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        return out

    def settle(doc: np.ndarray, h: np.ndarray, more: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """A batch's own repeats are hits at once (part below 0); only the earliest document of each window is sent on."""
        hit = later_than(h, more, doc)
        bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype("i4")
        return packed_batch([*shipped(bucket[~hit], doc[~hit], at[~hit], h[~hit], 8, more[~hit]), *shipped(-1 - dealt_documents(doc[hit], buckets), doc[hit], at[hit])])

    def verify(t: pa.Table) -> pa.Table:
        h, more, doc, at = opened_wide(t)
        hit = later_than(h, more, doc)
        return pa.Table.from_batches([packed_batch(list(shipped(dealt_documents(doc[hit], buckets), doc[hit], at[hit])))])

    # one join at every size: the marks grow with the documents, so they aren't sent to all executors
    tried = stored(alone.join(near, "doc_id").select("doc_id", "text", "spans").mapInArrow(windows, PACKED), "blocks-windows")
    hits = tried.filter("part >= 0").groupBy("part").applyInArrow(verify, PACKED).union(tried.filter("part < 0").withColumn("part", -1 - F.col("part")))
    all_words = F.lit(pack_spans(np.array([0]), np.array([WHOLE])))
    return stored(by_document(hits, words).union(later.select("doc_id", all_words.alias("spans"))), "blocks-spans")


def kept_words(words: list[bytes], spans: bytes | None, least: int = WORDS) -> list[bytes]:
    a, z = unpack_spans(spans)
    if not len(a) or len(words) < least:
        return words
    edge = [0, *np.minimum(np.stack([a, z], 1).ravel(), len(words)).tolist(), len(words)]
    return [w for s, e in zip(edge[::2], edge[1::2], strict=True) for w in words[s:e]]


def op2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bits = named(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            out = []
            for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                w = words_of(t)
                left = kept_words(w, s)
                out.append((len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    spans = repeats(docs.filter("row IS NOT NULL").select(F.col("row").alias("doc_id"), "text"), bits=bits).withColumnRenamed("doc_id", "row")
    return with_spans(docs, spans, "row").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM win) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit),
flat AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
keep AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s, count(*) AS n FROM flat ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN keep USING (doc_id)
"""
