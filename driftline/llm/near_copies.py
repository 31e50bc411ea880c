"""Near copies of whole texts: SimHash links first, completed to every pair of five-word Jaccard similarity 0.8 or more.

Two texts are near copies if the sets of their lower-cased five-word shingles have a Jaccard similarity of 0.8 or more.
Texts with equal sets are one class. Links are found in two steps, both verified on the complete sets:

1. Multi-index hashing (simhash.close_pairs): classes whose SimHash fingerprints differ in two bits or fewer.
2. Such pairs may lie up to a dozen bits apart, and no Hamming ball of affordable size reaches all. A prefix filter adds
   what is missing: with all sets sorted in one order, near copies share one of their first n // 5 + 1 shingles, n being
   the set's size, so classes that share one and aren't linked by step 1 are compared.

Candidates are dropped by bounds that hold for every near copy: sizes; places of the shared shingle in both orders; parity
bitmaps, whose difference is at most the sets'. Prefixes travel packed, one row for a bucket of shingles and a batch of
documents, and only pairs leave a bucket.

The order is by hash, but shingles that many texts start with come last (any fixed order is exact, so LATE_MOST, which
bounds that list, changes no result). A shingle that more than HOT classes still start with would give pairs that grow
with its square. Its classes are first held against four leaders; then only those outside the shingle's largest component
meet the members of other components.

Shingles are compared by 40 bits of their 64-bit hash.

Defined cases: null and empty text have the empty set, which equals itself only; fewer words than a shingle: the whole
sequence is one shingle; rows with a null doc_id are rows like any other; repeated rows return once each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.blocks import planes, unplanes
from driftline.llm.common import byte_size, dropped, few, guarded, mix, small_batches, stored, words_of
from driftline.llm.components import components
from driftline.llm.simhash import close_pairs, majority

SHINGLE, HOT, LATE_MOST = 5, 32, 1 << 20
SIGN = 1024
LONGS = SIGN // 64
BATCH = 1 << 20  # shingles
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 32  # of text


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of shingle hashes, 40 bits each."""
    words = words_of(text, lower=True)
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, "u8")
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out >> np.uint64(24))


def prefix(own: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The first len // 5 + 1 shingles, those in late (sorted) after all others."""
    if len(late) and len(own):
        last = late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own
        own = np.concatenate([own[~last], own[last]])
    return own[: len(own) // 5 + 1]


def parity(own: np.ndarray) -> np.ndarray:
    return np.packbits((np.bincount(own.astype("i8") % SIGN, minlength=SIGN) & 1).astype("u1")).view("<i8")


def text_digest() -> Column:
    """Tells texts of one doc_id apart; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def _key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def _edges(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a)) if len(a) else np.zeros(1, "i8")


def _dealt(token: np.ndarray, buckets: int, *cols: tuple[np.ndarray, int]) -> list[tuple]:
    """(bucket, packed tokens, packed cols): a row for each bucket, its tokens ascending."""
    bucket, q = token % np.uint64(buckets), token // np.uint64(buckets)
    order = np.lexsort((q, bucket))
    edge = _edges(bucket[order])
    out = []
    for a, z in zip(edge, edge[1:], strict=False):
        at = order[a:z]
        out.append((int(bucket[at[0]]), planes(np.diff(q[at], prepend=np.uint64(0)), 5), *(planes(c[at], w) for c, w in cols)))
    return out


def _opened(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.concatenate([unplanes(x.as_py(), width) for x in column])


def _tokens(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.cumsum(unplanes(x.as_py(), 5), dtype="u8") for x in column])


MARK = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("key", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("sign", pa.list_(pa.int64())), ("bucket", pa.int32()), ("tokens", pa.binary())])


def _marks(docs: DataFrame, buckets: int, hot: int) -> DataFrame:
    """Rows of documents (bucket null), and packed prefixes in order of hash by bucket, for counting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in few(batches):
            sets = [shingles(t) for t in part.column("text").to_pylist()]
            sign = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * LONGS, pa.int32()), pa.array(np.concatenate([parity(x) for x in sets])))
            fps = np.array([majority(mix(x)) for x in sets], "u8").view("i8")
            none = [None] * len(sets)
            cols = [part.column("doc_id"), part.column("digest"), pa.array([_key(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array(fps), sign, pa.array(none, pa.int32()), pa.array(none, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=MARK)
            held += [x[: len(x) // 4 + 1] for x in sets]
            size += sum(map(len, sets))
            if size >= BATCH:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        t = np.sort(np.concatenate(held))
        edge = _edges(t)
        rank = np.arange(len(t)) - np.repeat(edge[:-1], np.diff(edge))
        rows = _dealt(t[rank <= hot], buckets)  # more of a batch tell nothing more
        none = [pa.nulls(len(rows), f.type) for f in MARK][:6]
        return pa.RecordBatch.from_arrays([*none, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=MARK)

    made = docs.select(F.col("doc_id").cast("long"), text_digest().alias("digest"), "text")
    return made.mapInArrow(run, "doc_id long, digest binary, key long, n int, fp long, sign array<bigint>, bucket int, tokens binary")


def _frequent(marks: DataFrame, buckets: int, hot: int) -> DataFrame:
    """(token, n): shingles that more than hot texts start with."""

    def run(t: pa.Table) -> pa.Table:
        token, n = np.unique(_tokens(t.column("tokens")), return_counts=True)
        token = token * np.uint64(buckets) + np.uint64(t.column("bucket")[0].as_py())
        return pa.table({"token": pa.array(token[n > hot].view("i8")), "n": pa.array(n[n > hot], pa.int64())})

    return marks.filter("bucket IS NOT NULL").select("bucket", "tokens").groupBy("bucket").applyInArrow(run, "token long, n long")


def _met(docs: DataFrame, late, buckets: int, hot: int) -> DataFrame:
    """Pairs (a, b, n null) of classes that share a shingle of their prefixes, and classes b of n shingles under a crowded shingle a."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in few(batches):
            for t in b.column("text").to_pylist():
                own = shingles(t)
                held.append((_key(own), len(own), prefix(own, late.value)))
                size += len(own)
                if size >= BATCH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(p) for *_, p in held])
        key, n = (np.repeat(np.array([h[k] for h in held], "i8"), sizes) for k in (0, 1))
        place = np.concatenate([np.arange(k) for k in sizes])
        rows = _dealt(np.concatenate([p for *_, p in held]), buckets, (key, 8), (n, 4), (place, 4))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "tokens", "keys", "sizes", "places"])

    def meet(t: pa.Table) -> pa.Table:
        token, key = _tokens(t.column("tokens")), _opened(t.column("keys"), 8).view("i8")
        n, place = _opened(t.column("sizes"), 4).astype("i8"), _opened(t.column("places"), 4).astype("i8")
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        new = np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]))  # repeated rows are one class
        token, key, n, place = token[new], key[new], n[order][new], place[order][new]
        edge = _edges(token)
        many = np.repeat(np.diff(edge), np.diff(edge))
        us, vs = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
        small = np.flatnonzero((many > 1) & (many <= hot))
        for step in range(1, hot):
            i = small[: len(small) - step]
            j = small[step:]
            same = token[i] == token[j]
            if not same.any():
                break
            i, j = i[same], j[same]
            # shared shingles are at most those from the first common place on; near copies have 9 * common >= 4 * (both sizes)
            ok = (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (9 * np.minimum(n[i] - place[i], n[j] - place[j]) >= 4 * (n[i] + n[j]))
            us.append(key[i[ok]]), vs.append(key[j[ok]])
        pair = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
        hotter = many > hot
        name = (token[hotter] * np.uint64(buckets) + np.uint64(t.column("bucket")[0].as_py())).view("i8")
        return pa.table({"a": pa.array(np.append(pair[:, 0], name)), "b": pa.array(np.append(pair[:, 1], key[hotter])), "n": pa.array([*[None] * len(pair), *n[hotter].tolist()], pa.int32())})

    return docs.select("text").mapInArrow(send, "bucket int, tokens binary, keys binary, sizes binary, places binary").groupBy("bucket").applyInArrow(meet, "a long, b long, n int")


def _bound(u: str, v: str, un: str, vn: str) -> str:
    """Near copies have 9 * common >= 4 * (un + vn), so the sets differ in (un + vn) / 9 shingles at most."""
    far = " + ".join(f"bit_count({u}[{k}] ^ {v}[{k}])" for k in range(LONGS))
    return f"5 * least({un}, {vn}) >= 4 * greatest({un}, {vn}) and 9 * ({far}) <= {un} + {vn}"


def _near(pairs: DataFrame, docs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """Those of the stored pairs (u, v) that are near copies, stored."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            own = [shingles(t) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, own)], dtype="i4")
            yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in own], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view("i8")))], ["key", "own"])

    need = pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct()
    reps = stored(classes.join(need, "key", "left_semi").select("rep", "digest"), f"{name}-need")
    some = guarded(reps.select("rep", F.col("digest").alias("same")).distinct())
    texts = docs.join(some, F.col("doc_id").cast("long").eqNullSafe(F.col("rep")) & (text_digest() == F.col("same")), "left_semi")
    own = stored(texts.select("text").mapInArrow(sets, "key long, own array<bigint>"), f"{name}-sets")
    both = pairs.join(own.select(F.col("key").alias("u"), F.col("own").alias("a")), "u").join(own.select(F.col("key").alias("v"), F.col("own").alias("b")), "v")
    out = stored(both.filter("9 * size(array_intersect(a, b)) >= 4 * (size(a) + size(b))").select("u", "v"), f"{name}-near")
    dropped(own, reps)
    return out


def _fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Candidates of multi-index hashing: the least classes of near fingerprints, and each class with the least of its fingerprint."""
    least = classes.groupBy("fp").agg(F.min("key").alias("key"))
    ids = stored(least, "near-fingerprints")
    met = close_pairs(ids.select("fp")).join(ids.select(F.col("fp").alias("u"), F.col("key").alias("a")), "u").join(ids.select(F.col("fp").alias("v"), F.col("key").alias("b")), "v")
    same = classes.select("key", "fp").join(ids.withColumnRenamed("key", "a"), "fp").filter("key <> a").select("a", F.col("key").alias("b"))
    return met.select("a", "b").union(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def near_copies(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, digest (text_digest) and component (a long that near copies share, directly or over others) of each row. docs: a table that can be read again."""
    spark = docs.sparkSession
    docs = small_batches(docs.select("doc_id", "text"))
    buckets = max(LEAST_BUCKETS, byte_size(docs) // BUCKET_BYTES)
    both = stored(_marks(docs, buckets, hot), "near-marks")
    marks = both.filter("bucket IS NULL").drop("bucket", "tokens")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    classes = marks.groupBy("key").agg(first, F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("sign").alias("sign"))
    classes = stored(classes.select("key", F.col("first.doc_id").alias("rep"), F.col("first.digest").alias("digest"), "n", "fp", "sign"), "near-classes")
    side = lambda c: classes.select(F.col("key").alias(c), F.col("n").alias(f"{c}n"), F.col("sign").alias(f"{c}s"))
    bound = _bound("us", "vs", "un", "vn")
    within = lambda pairs, name: stored(pairs.join(side("u"), "u").join(side("v"), "v").filter(bound).select("u", "v"), name)

    close = _near(within(_fingerprint_pairs(classes), "near-close"), docs, classes, "near-first")

    often = _frequent(both, buckets, hot).orderBy(F.desc("n"), "token").limit(LATE_MOST)
    late = spark.sparkContext.broadcast(np.sort(np.array([r.token for r in often.select("token").collect()], "i8").view("u8")))
    spare = marks.join(classes.select("key", "rep", F.col("digest").alias("same")), "key").filter("not (doc_id <=> rep and digest = same)")
    spare = guarded(stored(spare.select(F.col("doc_id").alias("rep"), F.col("digest").alias("same")).distinct(), "near-spare"))
    alone = docs.join(spare, F.col("doc_id").cast("long").eqNullSafe(F.col("rep")) & (text_digest() == F.col("same")), "left_anti")
    met = stored(_met(alone, late, buckets, hot), "near-met")
    late.destroy()
    busy = met.filter("n IS NOT NULL").select(F.col("a").alias("token"), F.col("b").alias("key"), "n")
    by = F.xxhash64("key")
    lead = busy.groupBy("token").agg(F.array_distinct(F.array(F.min("key"), F.max("key"), F.min_by("key", by), F.max_by("key", by))).alias("lead")).select("token", F.explode("lead").alias("lead"))
    led = busy.join(lead, "token").filter("key <> lead").select(F.least("key", "lead").alias("u"), F.greatest("key", "lead").alias("v"))
    pairs = met.filter("n IS NULL").select(F.col("a").alias("u"), F.col("b").alias("v")).union(led).distinct()
    farther = _near(within(pairs.join(close, ["u", "v"], "left_anti"), "near-pairs"), docs, classes, "near-second")
    roots = components(close.union(farther), "near-links")
    if not busy.isEmpty():
        held = busy.join(classes.select("key", "sign"), "key").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        own = busy.groupBy("key").agg(F.collect_set("token").alias("own"))
        held = stored(held.join(own, "key").select("token", "key", "n", "sign", "root", "own"), "near-held")
        parts = held.groupBy("token", "root").agg(F.count("*").alias("m"))
        most = parts.groupBy("token").agg(F.max_by("root", F.struct("m", "root")).alias("most"), F.count("*").alias("parts")).filter("parts > 1").select("token", "most")
        outside = held.join(most, "token").filter("root <> most").select("token", F.col("key").alias("u"), F.col("n").alias("un"), F.col("sign").alias("us"), F.col("root").alias("ur"), F.col("own").alias("uo"))
        other = held.select(F.col("token").alias("at"), F.col("key").alias("v"), F.col("n").alias("vn"), F.col("sign").alias("vs"), F.col("root").alias("vr"), F.col("own").alias("vo"))
        # a pair is told at the least shingle that both are held under
        rest = outside.join(other, F.expr(f"token = at and ur <> vr and {bound} and token = array_min(array_intersect(uo, vo))"))
        rest = stored(rest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-rest")
        dropped(held)
        if not rest.isEmpty():
            known = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
            roots = components(known.union(_near(rest, docs, classes, "near-third")), "near-links")
    dropped(met)
    return marks.select("doc_id", "digest", "key").join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "digest", F.coalesce("root", "key").alias("component"))
