"""MinHash near-duplicates with sequential Bayesian verification.

Two documents are linked if the sets of their lower-cased word shingles have a Jaccard similarity of SIMILAR or more.
Documents with equal sets are one class, told by 128 bits of the set's digest. What links classes:

1. Banding. A signature has the least value of each of ROWS * BANDS hash functions over a set; classes that agree in all ROWS
   values of a band are candidates. A pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^40 = 1.3e-7.
2. Sequential verification. The signatures of a candidate pair are compared batch by batch, one byte of each value. After each
   batch the pair is dropped if, by the posterior of its similarity under a flat prior, SIMILAR or more has a probability
   below MISS. Most pairs go after the first batch.
3. Survivors are verified on their complete sets.

All pairs of a bucket would grow with its square. Each class is first held against four of its bucket, which settles
buckets that are groups of near copies. Where a bucket's classes are in several components after that, pairs across them follow:
all of them in buckets of at most HOT classes. For the classes of larger ones (the open classes) an exact filter on their full sets
comes first. With the shingles of a set in one order, those of the fewest open classes first, the least that two similar
sets share is among the first n // 5 + 1 of both. So a pair is found in one of two ways:

* by a shingle of at most HOT open classes among those first ones;
* or the two share no such shingle. Then all of a set's shingles that are so rare are missing in the other, and a class with more of them
  than a fifth of its set is linked with nothing in this way. What is left, outside the bucket's largest component, meets
  the classes of other components in the bucket, by a join that bounds the pair by both counts of rare shingles and by parity bitmaps.

Only this last join compares pairs that grow with the square of a bucket, and only those that pass the bounds leave it. Nothing is capped.

Shingles are compared by 64-bit hashes inside a pair or a document.

Defined cases: null, empty and blank texts have the empty set and are linked with nothing, each other included; fewer words than
a shingle: the whole sequence is one shingle; very long texts are read whole; repeated rows and equal sets are linked; a null doc_id
is no least one: a component's id is its least doc_id that there is, null if there is none, and such rows aren't kept
by op12; rows that share a doc_id may lie in different components; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import few, guarded, mix, small_batches, stored, table, words_of
from driftline.llm.components import components
from driftline.llm.near_copies import LONGS, parity

SHINGLE, SIMILAR = 4, (80, 100)
#: Rows and bands of each level; the first level's values are the signature.
LEVELS = ((5, 40),)
HOT, STEP, MISS = 16, 40, 1e-7
SLICE = 1 << 10  # shingles that meet all hash functions at once


def multipliers(level: int) -> np.ndarray:
    """An odd 64-bit number for each hash function of a level."""
    rows, bands = LEVELS[level]
    return np.fromiter((xxhash.xxh3_64_intdigest(f"{level}:{k}") | 1 for k in range(rows * bands)), "u8")


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingles, by 64-bit hash."""
    words = words_of(text, lower=True)
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, "u8")
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def least(own: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    out = np.full(len(by), 2**64 - 1, "u8")
    for at in range(0, len(own), SLICE):
        np.minimum(out, (own[None, at : at + SLICE] * by[:, None]).min(axis=1), out=out)
    return out


def bands_of(values: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit value for each band."""
    rows, bands = LEVELS[level]
    out = np.arange(bands, dtype="u8")
    for part in values.reshape(bands, rows).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out.view("i8")


def least_matches(n: int, similar: float = SIMILAR[0] / SIMILAR[1], miss: float = MISS) -> int:
    """The fewest matches among n compared bytes at which a similarity of `similar` or more isn't yet less likely than miss.

    A byte matches with r = s + (1 - s) / 256. With a flat prior on r, P(r >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    t = similar + (1 - similar) / 256
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def text_digest() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


MARK = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("key", pa.binary()), ("n", pa.int64()), ("sign", pa.binary()), ("bands", pa.list_(pa.int64()))])


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, key of the set, its size, its signature and its bands (both null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = multipliers(0)
        for b in few(batches):
            key, size, sign, bands = [], [], [], []
            for t in b.column("text").to_pylist():
                own = shingles(t)
                values = least(own, by) if len(own) else None
                key.append(xxhash.xxh3_128_digest(own.tobytes()))
                size.append(len(own))
                sign.append(None if values is None else (values >> np.uint64(32)).astype("u1").tobytes())
                bands.append(None if values is None else bands_of(values, 0))
            cols = [b.column("doc_id"), b.column("digest"), *(pa.array(c, f.type) for c, f in zip((key, size, sign, bands), list(MARK)[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(cols, schema=MARK)

    return docs.select(F.col("doc_id").cast("long"), text_digest().alias("digest"), "text").mapInArrow(run, "doc_id long, digest binary, key binary, n long, sign binary, bands array<long>")


def texts_of(docs: DataFrame, some: DataFrame) -> DataFrame:
    """(id, text) of stored classes (id, rep, digest); a row that repeats gives its id again."""
    some = guarded(some.select("id", F.col("rep"), F.col("digest").alias("same")))
    here = docs.join(some, F.col("doc_id").cast("long").eqNullSafe(F.col("rep")) & (text_digest() == F.col("same")))
    return here.select("id", "text")


def open_sets(docs: DataFrame, some: DataFrame) -> DataFrame:
    """(id, own, par) of stored classes: the set, and its parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            own, par = (pa.array([x.view("i8") for x in c], pa.list_(pa.int64())) for c in (sets, map(parity, sets)))
            yield pa.RecordBatch.from_arrays([b.column("id"), own, par], ["id", "own", "par"])

    return texts_of(docs, some).mapInArrow(run, "id long, own array<long>, par array<long>").dropDuplicates(["id"])


def prune(pairs: DataFrame, classes: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Those of the pairs (u, v) of classes that their signatures don't rule out."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"{c}n"), F.col("sign").alias(f"{c}s"))
    width = LEVELS[0][0] * LEVELS[0][1]
    steps = [(n, least_matches(n, similar[0] / similar[1])) for n in range(STEP, width + 1, STEP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = (np.frombuffer(b"".join(b.column(c).to_pylist()), "u1").reshape(-1, width) for c in ("us", "vs"))
            left, found = np.arange(b.num_rows), np.zeros(b.num_rows, "i8")
            for n, fewest in steps:
                found[left] += (us[left, n - STEP : n] == vs[left, n - STEP : n]).sum(axis=1)
                left = left[found[left] >= fewest]
            yield pa.RecordBatch.from_arrays([b.column("u").take(pa.array(left)), b.column("v").take(pa.array(left))], ["u", "v"])

    met = pairs.join(side("u"), "u").join(side("v"), "v").filter(f"{similar[1]} * least(un, vn) >= {similar[0]} * greatest(un, vn)")
    return met.select("u", "v", "us", "vs").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Those of the stored pairs (u, v) whose complete sets are similar, stored."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            own = [shingles(t) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, own)], dtype="i4")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view("i8")))], ["id", "own"])

    need = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    some = stored(classes.join(need, "id", "left_semi").select("id", "rep", "digest"), "minhash-need")
    own = stored(texts_of(docs, some).mapInArrow(sets, "id long, own array<long>").dropDuplicates(["id"]), "minhash-sets")
    both = pairs.join(own.select(F.col("id").alias("u"), F.col("own").alias("a")), "u").join(own.select(F.col("id").alias("v"), F.col("own").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return stored(both.filter(similar[1] * common >= similar[0] * (F.size("a") + F.size("b") - common)).select("u", "v"), "minhash-links")


def buckets(bands: DataFrame) -> DataFrame:
    """Stored: (band, value, id, lead, m) of all buckets with m > 1 classes; lead: four of them, by number and by hash. bands:
    stored (id, bands)."""
    each = bands.select("id", F.posexplode("bands").alias("band", "value"))
    by = F.xxhash64("id")
    four = F.array_distinct(F.array(F.min("id"), F.max("id"), F.min_by("id", by), F.max_by("id", by)))
    sizes = each.groupBy("band", "value").agg(F.count("*").alias("m"), four.alias("lead")).filter("m > 1")
    return stored(each.join(guarded(stored(sizes, "minhash-sizes")), ["band", "value"]).select("band", "value", "id", "lead", "m"), "minhash-buckets")


def led(met: DataFrame) -> DataFrame:
    """Pairs (u, v) of each class with the leaders of its buckets; most of a class' buckets have the same ones."""
    own = met.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("lead"))).alias("lead"))  # four for each band at most
    each = own.select("id", F.explode("lead").alias("lead")).filter("id <> lead")
    return each.select(F.least("id", "lead").alias("u"), F.greatest("id", "lead").alias("v")).distinct()


def mixed(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Stored: those buckets that have classes of several components, with root and most, the component with most of them."""
    held = met.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    parts = held.groupBy("band", "value", "root").agg(F.count("*").alias("k"))
    several = parts.groupBy("band", "value").agg(F.max_by("root", F.struct("k", "root")).alias("most"), F.count("*").alias("k")).filter("k > 1")
    return stored(held.join(several.drop("k"), ["band", "value"]), "minhash-mixed")


def small_pairs(met: DataFrame, cond: str = "true") -> DataFrame:
    """Pairs (u, v) of each list l of (id, root, n), HOT at most, that are in different components and meet the condition on x and y."""
    across = f"filter(slice(l, i + 2, size(l)), y -> y.root <> x.root and {cond})"
    pairs = f"flatten(transform(l, (x, i) -> transform({across}, y -> struct(least(x.id, y.id) as u, greatest(x.id, y.id) as v))))"
    return met.select(F.explode(F.expr(pairs)).alias("p")).select("p.*").distinct()


def filtered(docs: DataFrame, classes: DataFrame, open_: DataFrame, hot: int, similar: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) of different components that may be similar. open_: stored, as mixed returns it."""
    s, t = similar
    size = f"{t} * least(x.n, y.n) >= {s} * greatest(x.n, y.n)"
    roots = open_.select("id", "root").distinct()
    some = stored(classes.join(roots, "id").select("id", "root", "n", "rep", "digest"), "minhash-open")
    sets = stored(open_sets(docs, some), "minhash-open-sets")
    each = sets.select("id", F.explode("own").alias("shingle"))
    rare = each.groupBy("shingle").agg(F.count("*").alias("k")).filter(F.col("k") <= hot)
    own = each.join(rare, "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "shingle"))).alias("rare"))  # of one set
    held = stored(some.select("id", "root", "n").join(own, "id", "left").withColumn("rare", F.coalesce("rare", F.expr("cast(array() as array<struct<k: long, shingle: long>>)"))), "minhash-rare")

    first = held.select("id", "root", "n", F.explode(F.expr(f"slice(rare, 1, cast(n - ceil({s} * n / {t}) + 1 as int))")).alias("r")).filter("r.k > 1")
    lists = first.groupBy("r.shingle").agg(F.collect_list(F.struct("id", "root", "n")).alias("l"))  # hot at most

    # a pair without a rare shingle in common has n - rare in common at most
    left = held.select("id", "n", (F.col("n") - F.size("rare")).alias("c")).filter(f"{t} * c >= {s} * n").join(sets.select("id", "par"), "id")
    rows = open_.select("band", "value", "id", "root", "most").join(left, "id")
    outside = rows.filter("root <> most").select("band", "value", "most", *(F.col(c).alias(f"o{c}") for c in ("id", "root", "n", "c", "par")))
    other = rows.select("band", "value", *(F.col(c).alias(f"w{c}") for c in ("id", "root", "n", "c", "par")))
    far = " + ".join(f"bit_count(opar[{k}] ^ wpar[{k}])" for k in range(LONGS))
    # of two outside the largest component, the lesser meets the greater
    bound = f"oroot <> wroot and (wroot = most or oid < wid) and {s + t} * least(oc, wc) >= {s} * (on + wn) and {s + t} * ({far}) <= {t - s} * (on + wn)"
    rest = outside.join(other, ["band", "value"]).filter(bound)
    return small_pairs(lists, size).union(rest.select(F.least("oid", "wid").alias("u"), F.greatest("oid", "wid").alias("v"))).distinct()


def linked(docs: DataFrame, classes: DataFrame, hot: int = HOT, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(node, root) of linked classes. classes: stored (id, rep, digest, n, sign, bands), none empty."""
    met = buckets(classes.select("id", "bands"))

    def links(pairs: DataFrame) -> DataFrame:
        return verified(stored(prune(pairs, classes, similar), "minhash-survivors"), docs, classes, similar)

    def joined(roots: DataFrame, pairs: DataFrame) -> DataFrame:
        return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links(pairs)), "minhash-roots")

    roots = components(links(led(met)), "minhash-roots")
    few_of = mixed(met.filter((F.col("m") > 2) & (F.col("m") <= hot)), roots).filter(~F.array_contains("lead", F.col("id")))
    lists = few_of.groupBy("band", "value").agg(F.collect_list(F.struct("id", "root")).alias("l"))  # hot at most
    roots = joined(roots, small_pairs(lists))
    open_ = mixed(met.filter(F.col("m") > max(hot, 2)), roots)
    return roots if open_.isEmpty() else joined(roots, filtered(docs, classes, open_, hot, similar))


def near_duplicates(docs: DataFrame, hot: int = HOT, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id of each row. docs: a table that can be read again."""
    docs = small_batches(docs.select("doc_id", "text"))
    each = stored(marks(docs), "minhash-marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    classes = each.filter("n > 0").groupBy("key").agg(first, F.first("n").alias("n"), F.first("sign").alias("sign"), F.first("bands").alias("bands"))
    classes = stored(classes.select("key", F.monotonically_increasing_id().alias("id"), F.col("first.doc_id").alias("rep"), F.col("first.digest").alias("digest"), "n", "sign", "bands"), "minhash-classes")
    roots = linked(docs, classes, hot, similar)
    known = classes.select("key", "id", "rep").join(roots, F.col("id") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "id").alias("root"))
    heads = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = stored(known.join(heads, "root").select("key", "component_id"), "minhash-components")
    alone = each.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return each.filter("n > 0").join(ids, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(g) AS g FROM (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2) JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""
