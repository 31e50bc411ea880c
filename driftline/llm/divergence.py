"""Divergence of sources: how far the word distributions of the sources of a language lie apart, by joint count histograms.

Every (lang, source) group gives each kept term of its language the probability p = 1 + floor(SCALE * (n + 1) / (N + V)),
n being the term's occurrences in the group, N their sum and V the number of kept terms. The divergence of two groups sums
f(p, q) = floor((p - q)^2 / q) over all kept terms, with those that one or both groups lack.

p depends on a count alone, so f is evaluated once for each distinct combination of counts and multiplied by the number of
terms that have it. For a pair of groups the tally of (x, y) with x, y > 0 is counted from terms that both have; what it
implies for zeros follows by inclusion and exclusion from the groups' own histograms: (x, 0) from the terms of count x less
those that the pair shares, (0, 0) from V less all others. So no term is visited for a pair that lacks it.

Texts are counted in tasks and sums of a task shuffle, so a source with a third of all rows arrives as some rows for each
term and task. The results' size is that of the question: one row for each two sources of a language. Arithmetic is exact:
decimals of 31 digits before the division, longs and decimals of 38 after.

Defined cases: null text, lang and source count as ''; a group without terms is a group, with p = 1 + floor(SCALE / V) for all;
without kept terms all divergences are 0; a language with one source has no pairs; repeated rows count each, as occurrences
and as documents; ties in rank are settled by the item's UTF-8 bytes; very long texts are read whole, piece by piece; an empty
table gives an empty result; doc_id and other columns are ignored.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.common import dropped, few, guarded, small_batches, stored, table

LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
HELD, PIECE = 1 << 17, 1 << 20
#: Letters of terms are kept, A-Z lower-cased; other ASCII characters part them.
KEEP = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_letters else b if b > 127 else 32 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """A text's terms in pieces of about PIECE bytes."""
    data = text.encode().translate(KEEP)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE) if at + PIECE < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), with a row of null term for every group: occurrences and documents of a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in few(batches):
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, found = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), Counter()
                for piece in terms_of(text):
                    own.update(piece)
                n.update(own)
                found.update(own.keys())
                size += len(n) - before
                if size >= HELD:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, found) in held.items():
            terms = [None, *n]
            cols = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            cols += [pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(found.__getitem__, n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema=SCHEMA)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    part = small_batches(docs.select(blank("lang"), blank("source"), blank("text"))).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def chance(n: str, total: str) -> Column:
    return F.expr(f"1 + ({SCALE}BD * cast({n} + 1 as decimal(20, 0))) div cast({total} as decimal(20, 0))")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


class Counts:
    """Stored counts: kept (lang, gid, term, n, n_all), groups (gid, lang, source, total, total_all, v)."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS) -> None:
        counts = stored(count_terms(docs), "divergence-counts")
        by = Window.partitionBy("lang", "term")  # a row for each source at most
        of_terms = counts.filter("term IS NOT NULL").withColumn("n_all", F.sum("n").over(by)).withColumn("docs", F.sum("docs").over(by))
        kept = of_terms.filter(F.col("docs") >= least_docs).drop("docs").withColumn("first", F.row_number().over(by.orderBy("source")) == 1)
        kept = stored(kept, "divergence-terms")
        langs = kept.groupBy("lang").agg(F.sum("n").alias("all"), F.sum(F.col("first").cast("long")).alias("v"))
        own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
        groups = counts.filter("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["own", "all", "v"])
        self.groups = stored(groups.select(F.monotonically_increasing_id().alias("gid"), "lang", "source", (F.col("own") + F.col("v")).alias("total"), (F.col("all") + F.col("v")).alias("total_all"), "v"), "divergence-groups")
        self.kept = kept.join(guarded(self.groups.select("gid", "lang", "source")), ["lang", "source"]).select("lang", "gid", "term", "n", "n_all")
        dropped(counts)


def joint_histograms(c: Counts) -> DataFrame:
    """(u, v, x, y, m) for groups u < v of a language: m > 0 kept terms occur x times in u and y times in v."""
    k = c.kept.select("lang", "term", "gid", "n")
    a, b = k.select("lang", "term", F.col("gid").alias("u"), F.col("n").alias("x")), k.select("lang", "term", F.col("gid").alias("v"), F.col("n").alias("y"))
    joint = stored(a.join(b, ["lang", "term"]).filter("u < v").groupBy("u", "v", "x", "y").agg(F.count("*").alias("m")), "divergence-joint")
    single = stored(k.groupBy("gid", "n").agg(F.count("*").alias("m")), "divergence-single")
    g = c.groups.filter("v > 0").select("gid", "lang", F.col("v").alias("terms"))
    pairs = g.select(F.col("gid").alias("u"), "lang", "terms").join(g.select(F.col("gid").alias("v"), "lang"), "lang").filter("u < v")
    left = pairs.join(single.withColumnRenamed("gid", "u"), "u")
    right = pairs.join(single.withColumnRenamed("gid", "v"), "v")
    nil = F.lit(0).cast("long")
    cells = joint.select("u", "v", F.explode(F.expr("array(struct(x, y, m), struct(x, 0L as y, -m as m), struct(0L as x, y, -m as m), struct(0L as x, 0L as y, m))")).alias("c")).select("u", "v", "c.*")
    for more in (
        left.select("u", "v", F.col("n").alias("x"), nil.alias("y"), "m"), left.select("u", "v", nil.alias("x"), nil.alias("y"), (-F.col("m")).alias("m")),
        right.select("u", "v", nil.alias("x"), F.col("n").alias("y"), "m"), right.select("u", "v", nil.alias("x"), nil.alias("y"), (-F.col("m")).alias("m")),
        pairs.select("u", "v", nil.alias("x"), nil.alias("y"), F.col("terms").alias("m")),
    ):
        cells = cells.union(more)
    return cells.groupBy("u", "v", "x", "y").agg(F.sum("m").alias("m")).filter("m > 0")


def pair_divergences(c: Counts) -> DataFrame:
    """(gid, other, value) for each group and each other of its language."""
    of = lambda e: guarded(c.groups.select(F.col("gid").alias(e), F.col("total").alias(f"{e}_total")))
    cells = joint_histograms(c).join(of("u"), "u").join(of("v"), "v").withColumn("p", chance("x", "u_total")).withColumn("q", chance("y", "v_total"))
    times = F.col("m").cast("decimal(20, 0)")
    sums = cells.groupBy("u", "v").agg(F.sum(apart("p", "q") * times).alias("uv"), F.sum(apart("q", "p") * times).alias("vu"))
    both = sums.select(F.explode(F.expr("array(struct(u as gid, v as other, uv as value), struct(v as gid, u as other, vu as value))")).alias("r")).select("r.*")
    g = c.groups
    wanted = g.select("gid", "lang").join(g.select(F.col("gid").alias("other"), "lang"), "lang").filter("gid <> other").select("gid", "other")
    return wanted.join(both, ["gid", "other"], "left").select("gid", "other", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def term_divergences(c: Counts) -> DataFrame:
    """(gid, term, value) for terms that occur in a group more often than in its language."""
    g = guarded(c.groups.select("gid", "total", "total_all"))
    each = c.kept.join(g, "gid").withColumn("p", chance("n", "total")).withColumn("q", chance("n_all", "total_all"))
    return each.filter("p > q").select("gid", "term", apart("p", "q").alias("value"))


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources of a language, and each source's top terms."""
    c = Counts(docs, least_docs)
    names = guarded(c.groups.select("gid", "lang", "source"))
    by = lambda item: F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), item))
    others = guarded(c.groups.select(F.col("gid").alias("other"), F.col("source").alias("item")))
    pairs = pair_divergences(c).join(others, "other").withColumn("rank", by("item")).withColumn("part", F.lit("pair"))
    terms = term_divergences(c).withColumnRenamed("term", "item").withColumn("rank", by("item")).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    cols = ("gid", "part", "item", "value", "rank")
    return pairs.select(*cols).union(terms.select(*cols)).join(names, "gid").select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
l AS (SELECT lang, term, count(*)::HUGEINT AS n FROM d GROUP BY ALL HAVING count(DISTINCT id) >= 3),
lt AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM l GROUP BY ALL),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM d SEMI JOIN l USING (lang, term) GROUP BY ALL),
ct AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0)::HUGEINT AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(ct.total, 0) + lt.v) AS p, 1 + (1000000000::HUGEINT * (l.n + 1)) // (lt.total + lt.v) AS q
    FROM g JOIN l USING (lang) JOIN lt USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN ct USING (lang, source)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""
