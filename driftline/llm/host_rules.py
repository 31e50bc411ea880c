"""Quality rules with a verdict for each host, in DataFrame functions only.

Documents fail a base rule (fewer than 50 words, or over half of the words in repeated 3-word windows) or are doubtful
(more than a symbol for each SYMBOL_WORDS words). Failures of both kinds are counted by host (the column source), and each
host's rate is shrunk towards a beta prior that is fitted to all hosts by moments. The shrunk rate is the host's verdict,
which is joined back to its documents:

rejected  over HOST_LIMIT: none of its documents is kept
trusted   under TRUST times the prior's mean: its doubtful documents are kept too
plain     otherwise: its doubtful documents go

A small host needs a much better rate than a large one to be trusted. Host counts are aggregated before any shuffle, and
verdicts are joined back by host, so a host with a third of all rows needs no task of its own.

Defined cases: null or empty text has no words and fails; very long texts are read whole, in one row; a null host is a host
of its own; a null or repeated doc_id changes nothing; repeated rows count and return once each; ties with a limit are not
over or under it; one or equal hosts get the prior strength STRENGTH[0]; an empty table gives an empty result; other
columns are ignored. Repeated windows are told apart by a 64-bit hash of the three words within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import stored, table

SPACE = "[ \\t\\n\\x0B\\f\\r]+"
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOL_WORDS = 10
HOST_LIMIT, TRUST, STRENGTH = 0.5, 0.9, (10.0, 10_000.0)


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, source and the base counts of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w, g, s, d = map(F.col, ("_w", "_g", "_s", "_d"))
    step = docs.select(
        "doc_id", "source", F.array_remove(F.split(text, SPACE), "").alias("_w"), (F.size(F.split(text, "[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("_l"),
    )
    step = step.select(
        "doc_id", "source", "n_symbols", F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) >= 3, F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.size(w) - 2)).alias("_g"),
    )
    keep = ["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    # only texts in which some window comes twice need their windows sorted
    step = step.select(*keep, F.when(F.size(F.array_distinct(g)) < F.size(g), F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    near = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
    step = step.select(*keep, F.array_sort(F.transform(F.filter(s, near), lambda x: x["i"])).alias("_d"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(d, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return step.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def doubtful() -> Column:
    return ~failed() & (SYMBOL_WORDS * F.col("n_symbols") > F.col("n_words"))


def host_verdicts(base: DataFrame, limit: float = HOST_LIMIT, trust: float = TRUST) -> DataFrame:
    """source, host_docs, host_failed, host_verdict for every host. base: rows with source and failing."""
    hosts = base.groupBy("source").agg(F.count("*").alias("host_docs"), F.sum(F.col("failing").cast("long")).alias("host_failed"))
    prior = hosts.select((F.col("host_failed") / F.col("host_docs")).alias("r")).agg(F.avg("r").alias("m"), F.coalesce(F.var_samp("r"), F.lit(0.0)).alias("v"))
    fit = F.when(F.col("v") > 1e-12, F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).otherwise(STRENGTH[0])
    one = prior.select("m", fit.alias("strength"))  # a single row
    rate = (F.col("host_failed") + F.col("m") * F.col("strength")) / (F.col("host_docs") + F.col("strength"))
    verdict = F.when(rate > limit, "rejected").when(rate < trust * F.col("m"), "trusted").otherwise("plain")
    return hosts.join(F.broadcast(one)).select("source", "host_docs", "host_failed", verdict.alias("host_verdict"))


def quality_rules(docs: DataFrame, limit: float = HOST_LIMIT, trust: float = TRUST) -> DataFrame:
    base = base_rules(docs).withColumn("base_failed", failed()).withColumn("doubtful", doubtful())
    base = stored(base.withColumn("failing", F.col("base_failed") | F.col("doubtful")), "host-rules")
    hosts = host_verdicts(base, limit, trust).withColumnRenamed("source", "_host")
    joined = base.join(hosts, F.col("source").eqNullSafe(F.col("_host")), "left")
    spared = ~F.col("doubtful") | (F.col("host_verdict") == "trusted")
    return joined.drop("_host").withColumn("kept", ~F.col("base_failed") & (F.col("host_verdict") != "rejected") & spared)


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failed", "host_verdict")


ORACLE = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY 1),
base AS (SELECT t.doc_id, source, len(w) AS n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM t JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
flag AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words AS many FROM base),
hosts AS (SELECT source, count(*) AS host_docs, sum((base_failed OR many)::INT)::BIGINT AS host_failed FROM flag GROUP BY 1),
prior AS (SELECT avg(host_failed / host_docs) AS m, coalesce(var_samp(host_failed / host_docs), 0) AS v FROM hosts),
fit AS (SELECT m, CASE WHEN v > 1e-12 THEN least(greatest(m * (1 - m) / v - 1, 10.0), 10000.0) ELSE 10.0 END AS s FROM prior),
rate AS (SELECT source, host_docs, host_failed, (host_failed + m * s) / (host_docs + s) AS r, m FROM hosts, fit),
verdict AS (SELECT source, host_docs, host_failed, CASE WHEN r > 0.5 THEN 'rejected' WHEN r < 0.9 * m THEN 'trusted' ELSE 'plain' END AS host_verdict FROM rate)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND host_verdict <> 'rejected' AND (NOT many OR host_verdict = 'trusted') AS kept, host_docs, host_failed, host_verdict
FROM flag JOIN verdict ON flag.source IS NOT DISTINCT FROM verdict.source
"""
