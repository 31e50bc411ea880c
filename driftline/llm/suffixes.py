"""Suffix-array dedup: repeated byte strings by column-wise construction of a collection's transform.

A string repeats if WIDTH bytes also start anywhere else. The work is cut into small collections first. Every window
of WIDTH bytes is named by the least hash of its GRAM-byte grams (its anchor); a document's windows fall into segments that
share an anchor, and equal windows always have equal anchors at equal offsets. So only segments with the same anchor
hash can share a window, and each such collection is independent:

* segments that occur twice as a whole (most repeats) are settled by their hashes, map-side first;
* an anchor that occurs once is dropped;
* for the others the segments' bytes are fetched, aligned by their anchors, and their transform is built column by column from the
  right: each round inserts one symbol for each segment, re-sorts the suffixes stably by it and updates the longest
  common prefixes of neighbours from the round before. Neighbours that share WIDTH symbols are repeated windows.

One round for a column of at most 2 * WIDTH bounds the rounds whatever the documents' lengths; a construction over
whole documents would need a round for each byte of the longest and rewrite the transform each time. Between the
passes the collections lie in sequential tables in the shared folder.

An anchor with more than CROWD different segments would be one large group (a common line with many surroundings); its
windows are counted one by one by hash instead, which pre-aggregates. Exact copies are settled by their text's hash first.
Segments are compared by 64-bit polynomial hashes besides the anchor's own.

Defined cases: null text is empty; texts below WIDTH bytes keep all; very long texts go in parts; rows are told apart by doc_id
(null too) and text, so rows that share a doc_id but not the text are documents of their own, and rows that repeat both are
copies of each other; where a string occurs often all its places are equal, so there are no ties; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.blocks import PACKED, dealt_documents, opened, packed_batch, places, planes, shipped, union_spans, unplanes
from driftline.llm.blocks import by_document as by_places
from driftline.llm.common import byte_size, few, guarded, merge, mix, pack_spans, row_key, small_batches, stored, table, unpack_spans, with_spans

WIDTH, GRAM = 200, 64
BATCH, CROWD = 1 << 20, 1024
SLICE = 1 << 18  # bytes that have arrays of 64-bit values at once
BUCKET_BYTES = 32 << 20
PART_SEGMENTS = 1 << 13  # of the constructions in one group
BASE = 0x5851F42D4C957F2D
MASK = np.uint64((1 << 22) - 1)
DONE, OPEN, CROWDED = 0, 1, 2


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, grown as needed."""

    up = down = np.ones(1, "u8")

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                a = np.full(n, base, "u8")
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up[:n], cls.down[:n]


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n = len(a) - w + 1
    top = np.full(-(-len(a) // w) * w, np.iinfo("u8").max, "u8")
    top[: len(a)] = a
    rows = top.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    up, down = Powers.of(len(data) + 1)
    p = np.append(np.zeros(1, "u8"), np.cumsum((data.astype("u8") + np.uint64(1)) * up[:-1], dtype="u8"))
    return mix((p[width:] - p[:-width]) * down[: len(data) - width + 1])


def segments(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """data: documents' bytes one after the other, 2^22 at most; ends: the end of each document. Returns for each segment
    its start, number of windows, anchor's offset, anchor's hash and own hash."""
    n = len(data)
    none = np.zeros(0, "i8")
    if n < width:
        return none, none, none, none.astype("u8"), none.astype("u8")
    up, down = Powers.of(n + 1)
    p = np.append(np.zeros(1, "u8"), np.cumsum((data.astype("u8") + np.uint64(1)) * up[:-1], dtype="u8"))
    g = mix((p[gram:] - p[:-gram]) * down[: n - gram + 1])
    least = sliding_min((g & ~MASK) | np.arange(len(g), dtype="u8"), width - gram + 1)
    lengths = np.diff(np.append(0, ends))
    room = np.repeat(ends, lengths)[: len(least)] - np.arange(len(least)) >= width  # the window stays inside its document
    first = room & np.append(True, (least[1:] != least[:-1]) | ~room[:-1])
    last = room & np.append((least[1:] != least[:-1]) | ~room[1:], True)
    start, stop = np.flatnonzero(first), np.flatnonzero(last)
    anchor = (least[start] & MASK).astype("i8")
    end = stop + width
    own = mix((p[end] - p[start]) * down[start] + (end - start).astype("u8") * np.uint64(0x9E3779B97F4A7C15))
    return start, stop - start + 1, anchor - start, g[anchor], own


def segments_of(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """segments() of the texts one after the other, for few of them at a time: they take some 60 bytes for each of a text's."""
    ends = np.cumsum([0, *map(len, texts)])
    found, a = [], 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, side="right")) - 1)
        start, *more = segments(np.frombuffer(b"".join(texts[a:z]), "u1"), ends[a + 1 : z + 1] - ends[a], width, gram)
        found.append((start + ends[a], *more))
        a = z
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def sent_segments(docs: DataFrame, buckets: int, width: int, gram: int) -> DataFrame:
    """Packed segments by bucket of their anchors; bucket -1 has those that are settled, -2 those of crowded anchors."""
    names = ("h", "own", "docs", "runs", "start", "wins", "off", "flag")

    def packed(bucket: int, h, own, doc, start, wins, off, flag) -> tuple:
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, int)
        return (bucket, planes(h, 6), own.astype("<u8").tobytes(), doc[first].astype("<i8").tobytes(), planes(np.diff(np.append(first, len(doc))), 4), planes(start, 8), planes(wins, 2), planes(off, 2), flag.astype("u1").tobytes())

    def flush(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch | None:
        ends = np.cumsum([len(t) for _, _, t in parts])
        start, wins, off, h, own = segments_of([t for _, _, t in parts], width, gram)
        if not len(start):
            return None
        k = np.searchsorted(ends, start, side="right")
        doc = np.array([d for d, _, _ in parts], "i8")[k]
        start = start - np.append(0, ends)[k] + np.array([at for _, at, _ in parts], "i8")[k]
        order = np.lexsort((own, h))
        new = np.append(True, (own[order][1:] != own[order][:-1]) | (h[order][1:] != h[order][:-1]))
        group = np.cumsum(new) - 1
        twice = np.zeros(len(h), bool)
        twice[order] = (np.bincount(group) > 1)[group]
        lead = np.zeros(len(h), bool)
        lead[order] = new
        hs = h[order][new]  # of different segments
        edge = np.append(np.flatnonzero(np.append(True, hs[1:] != hs[:-1])), len(hs))
        many = np.diff(edge) > CROWD
        crowded = np.zeros(len(h), bool)
        crowded[order] = np.repeat(many, np.diff(edge))[group]
        flag = twice.astype("u1") | crowded.astype("u1") << 1
        some = np.zeros(len(h), bool)  # one of each crowded anchor tells the others
        some[order[np.flatnonzero(new)[edge[:-1][many]]]] = True
        cols = (h, own, doc, start, wins, off, flag)
        rows = []
        ship = lead & ~crowded | some
        bucket = ((h >> np.uint64(48)) % np.uint64(buckets)).astype("i4") if buckets > 1 else np.zeros(len(h), "i4")
        by = np.flatnonzero(ship)[np.argsort(bucket[ship], kind="stable")]
        cut = np.append(np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1])), len(by))
        rows += [packed(int(bucket[by[a]]), *(c[by[a:z]] for c in cols)) for a, z in zip(cut, cut[1:], strict=False)]
        for kind, which in ((-1, twice), (-2, crowded & lead)):
            if which.any():
                rows.append(packed(kind, *(c[which] for c in cols)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 8), strict=True)], ["bucket", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in few(batches):
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = (t or "").encode()
                for at in range(0, max(1, len(data) - width + 1), BATCH):  # long texts in parts that share all but one byte of a window
                    part = data[at : at + BATCH + width - 1]
                    if len(part) >= width:
                        parts.append((d, at, part))
                        size += len(part)
                    if size >= BATCH:
                        if (out := flush(parts)) is not None:
                            yield out
                        parts, size = [], 0
        if parts and (out := flush(parts)) is not None:
            yield out

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, h binary, own binary, docs binary, runs binary, start binary, wins binary, off binary, flag binary")


def by_document(doc: np.ndarray, kind: int, *cols: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.argsort(doc, kind="stable")
    d = doc[order]
    edge = np.append(np.flatnonzero(np.append(True, d[1:] != d[:-1])), len(d)) if len(d) else np.zeros(1, int)
    a = np.stack([c[order].astype("i8") for c in cols])
    return [(int(d[x]), kind, a[:, x:z].T.astype("<i8").tobytes()) for x, z in zip(edge, edge[1:], strict=False)]


def sorted_out(sent: DataFrame, width: int) -> DataFrame:
    """(doc_id, kind, data): DONE intervals as packed (start, end) rows; OPEN and CROWDED segments as (start, windows, offset, anchor)."""

    def meet(t: pa.Table) -> pa.Table:
        get = lambda c: [x.as_py() for x in t.column(c)]
        kind = t.column("bucket")[0].as_py()
        wide = lambda c, n: np.concatenate([unplanes(x, n) for x in get(c)])
        h, start, wins, off = wide("h", 6), wide("start", 8).astype("i8"), wide("wins", 2).astype("i8"), wide("off", 2).astype("i8")
        own, flag = np.frombuffer(b"".join(get("own")), "<u8"), np.frombuffer(b"".join(get("flag")), "u1")
        doc = np.concatenate([np.repeat(np.frombuffer(d, "<i8"), unplanes(r, 4).astype("i8")) for d, r in zip(get("docs"), get("runs"), strict=True)])
        if kind < 0:
            done, opened, crowded = np.full(len(h), kind == -1), np.zeros(len(h), bool), np.full(len(h), kind == -2)
        else:
            order = np.lexsort((own, h))
            hs, os = h[order], own[order]
            anew = np.append(True, hs[1:] != hs[:-1])
            new = anew | np.append(True, os[1:] != os[:-1])
            ag, sg = np.cumsum(anew) - 1, np.cumsum(new) - 1
            twice = ((np.bincount(sg) > 1) | (np.bincount(sg, flag[order] & 1) > 0))[sg]
            kinds = np.bincount(ag, new)[ag]
            hot = ((np.bincount(ag, flag[order] >> 1) > 0)[ag]) | (kinds > CROWD)
            done, opened, crowded = (np.zeros(len(h), bool) for _ in range(3))
            done[order] = twice
            opened[order] = (kinds > 1) & ~hot & new
            crowded[order] = hot & new & (flag[order] < 2)  # the batch has sent its own already
        rows = by_document(doc[done], DONE, start[done], start[done] + wins[done] - 1 + width)
        for k, which in ((OPEN, opened), (CROWDED, crowded)):
            rows += by_document(doc[which], k, start[which], wins[which], off[which], h[which])
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "kind", "data"), cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)})

    dealt = sent.withColumn("part", F.when(F.col("bucket") < 0, F.xxhash64("docs", "start")).otherwise(F.lit(0)))
    return dealt.groupBy("bucket", "part").applyInArrow(meet, "doc_id long, kind int, data binary")


def repeated_columns(group: np.ndarray, data: list[bytes], off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) pairs that repeat within their group. group: ascending; off: each anchor's offset."""
    m = len(data)
    size = np.array([len(x) for x in data])
    left = int(off.max(initial=0))
    lo = left - off
    hi = lo + size
    cols = int(hi.max(initial=0))
    x = np.zeros((cols, m), "u2")  # 0: no symbol
    for i, d in enumerate(data):
        x[lo[i] : hi[i], i] = np.frombuffer(d, "u1").astype("u2") + 1
    order, lcp = np.arange(m), np.zeros(m, "i4")
    seg, win = [], []
    for c in range(cols - 1, -1, -1):
        key = group[order] * 257 + x[c, order]
        perm = np.argsort(key, kind="stable")  # old ranks in the new order
        k = key[perm]
        same = np.flatnonzero((k[1:] == k[:-1]) & (k[1:] % 257 != 0)) + 1
        new = np.zeros(m, "i4")
        if len(same):
            a, z = perm[same - 1] + 1, perm[same]  # least common prefix over old ranks a .. z
            span = z - a + 1
            level = np.log2(span).astype("i8")
            low, got = lcp, np.empty(len(span), "i4")
            for e in range(int(level.max()) + 1):
                at = np.flatnonzero(level == e)
                got[at] = np.minimum(low[a[at]], low[z[at] - (1 << e) + 1])
                low = np.minimum(low[: -(1 << e)], low[1 << e :]) if len(low) > 1 << e else low
            new[same] = got + 1
        order, lcp = order[perm], new
        if c <= cols - width:
            hit = (lcp >= width) | np.append(lcp[1:] >= width, False)
            i = order[hit]
            seg.append(i), win.append(c - lo[i])
    return (np.concatenate(seg), np.concatenate(win)) if seg else (np.zeros(0, "i8"), np.zeros(0, "i8"))


def repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, spans): maximal runs of bytes under strings of width bytes that also start elsewhere. docs: (doc_id, text);
    doc_id, a long, tells texts apart: see row_key."""
    size = byte_size(small_batches(docs))
    buckets = max(1, size // BUCKET_BYTES + 1)
    digest = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).filter(F.col("size") >= width)
    copies = digest.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    copied = stored(digest.join(copies, "digest").select("doc_id", "rep", F.col("size").cast("long").alias("size")).distinct(), "suffixes-copies")
    alone = docs.join(guarded(copied.filter("doc_id > rep").select("doc_id")), "doc_id", "left_anti")
    out = stored(sorted_out(sent_segments(alone, buckets, width, gram), width), "suffixes-sorted")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if "size" in b.schema.names:
                spans = [pack_spans(np.array([0]), np.array([n])) for n in b.column("size").to_pylist()]
            else:
                spans = [pack_spans(*merge(*np.frombuffer(x, "<i8").reshape(-1, 2).T)) for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.binary())], ["doc_id", "spans"])

    pair = "doc_id long, spans binary"
    found = copied.select("doc_id", "size").mapInArrow(whole, pair).union(out.filter(F.col("kind") == DONE).select("doc_id", "data").mapInArrow(whole, pair))
    todo = stored(out.filter(F.col("kind") != DONE).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "data")).alias("l")).mapInArrow(gathered, pair), "suffixes-todo")
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            rows = []
            for d, t, s in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = (t or "").encode()
                for kind, start, wins, off, anchor in np.frombuffer(s, "<i8").reshape(-1, 5).tolist():
                    rows.append((kind, anchor, d, start, off, data[start : start + wins - 1 + width]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["kind", "anchor", "doc_id", "start", "off", "data"])

    fetched = stored(with_spans(alone, todo, how="inner").select("doc_id", "text", "spans").mapInArrow(fetch, "kind int, anchor long, doc_id long, start long, off long, data binary"), "suffixes-segments")

    def construct(t: pa.Table) -> pa.Table:
        t = t.sort_by("anchor")
        anchor = t.column("anchor").to_numpy()
        doc, start, off = (t.column(c).to_numpy() for c in ("doc_id", "start", "off"))
        data = t.column("data").to_pylist()
        ds, ss = [], []
        edge = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
        at = 0
        while at < len(edge) - 1:  # whole groups, some PART_SEGMENTS segments at a time
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + PART_SEGMENTS, side="right")) - 1)
            a, z = edge[at], edge[to]
            g = np.cumsum(np.append(0, anchor[a + 1 : z] != anchor[a : z - 1]))
            seg, win = repeated_columns(g, data[a:z], off[a:z], width)
            ds.append(doc[a:z][seg]), ss.append(start[a:z][seg] + win)
            at = to
        d, s = np.concatenate(ds), np.concatenate(ss)
        return places(d, s, s + width)

    aligned = fetched.filter(F.col("kind") == OPEN)
    parts = aligned.count() // PART_SEGMENTS + 1
    found = found.union(aligned.withColumn("part", F.pmod("anchor", F.lit(parts))).groupBy("part").applyInArrow(construct, pair))
    crowded = fetched.filter(F.col("kind") == CROWDED)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            hs = [window_hashes(np.frombuffer(x, "u1"), width) for x in b.column("data").to_pylist()]
            n = [len(h) for h in hs]
            h = np.concatenate(hs)
            at = np.concatenate([s + np.arange(k) for s, k in zip(b.column("start").to_pylist(), n, strict=True)])
            doc = np.repeat(b.column("doc_id").to_numpy(), n)
            order = np.argsort(h, kind="stable")
            first = np.append(True, h[order][1:] != h[order][:-1])
            many = (np.bincount(np.cumsum(first) - 1) > 1)[np.cumsum(first) - 1]
            twice, sent = np.zeros(len(h), bool), np.zeros(len(h), bool)
            twice[order] = many
            sent[order] = first | np.append(False, first[:-1])  # two of each tell that it repeats
            bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype("i4")
            yield packed_batch([*shipped(bucket[sent], doc[sent], at[sent], h[sent], 8), *shipped(-1 - dealt_documents(doc[twice], buckets), doc[twice], at[twice])])

    def count(t: pa.Table) -> pa.Table:
        h, doc, at = opened(t, 8)
        _, group, n = np.unique(h, return_inverse=True, return_counts=True)
        hit = (n > 1)[group]
        return pa.Table.from_batches([packed_batch(list(shipped(dealt_documents(doc[hit], buckets), doc[hit], at[hit])))])

    if not crowded.isEmpty():
        single = stored(crowded.mapInArrow(each, PACKED), "suffixes-crowded")
        met = single.filter("part >= 0").groupBy("part").applyInArrow(count, PACKED).union(single.filter("part < 0").withColumn("part", -1 - F.col("part")))
        found = found.union(by_places(met, width))
    return stored(union_spans(found), "suffixes-spans")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All segments of a document in one value: (kind, start, windows, offset, anchor) rows."""
    for b in batches:
        out = []
        for parts in b.column("l").to_pylist():
            a = [np.frombuffer(p["data"], "<i8").reshape(-1, 4) for p in parts]
            out.append(np.concatenate([np.insert(x, 0, p["kind"], axis=1) for x, p in zip(a, parts, strict=True)]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "spans"])


def kept_bytes(data: bytes, spans: bytes | None) -> tuple[bytes, int]:
    """What is left, and the number of runs removed."""
    a, z = unpack_spans(spans)
    edge = [0, *np.stack([a, z], 1).ravel().tolist(), len(data)]
    return b"".join(data[s:e] for s, e in zip(edge[::2], edge[1::2], strict=True)), len(a)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), row_key().alias("row"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            out = []
            for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = (t or "").encode()
                left, runs = kept_bytes(data, s)
                out.append((len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 3, pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = repeats(docs.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
    return with_spans(docs, spans, "row").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
