"""Toxicity by weak supervision.

1. A lexicon of words and word beginnings is drawn from a bounded sample of labelled rows (document frequencies in
   toxic and clean texts).
2. VOTERS voters hold a share of the lexicon each (terms that begin alike share a voter, so one word moves one voter) and
   vote "toxic" or abstain; pattern voters look at the number of words that the lexicon knows, capitals, exclamation and
   address, and some vote "clean".
3. A generative label model with a hidden class is fitted by expectation maximisation to the votes of all documents
   that may be learnt from: what each voter says given the class, and the correlations of voters within a class;
   correlated voters share their weight. The start is supervised: the first round counts what the voters say of labelled
   documents. The label, where there is one, is the last voter, with an accuracy estimated like that of the others.
4. A linear classifier learns the posterior of a bounded sample of documents, and scores every whole text.

The vote table is aggregated to counts of equal votes; each round of the label model is one distributed sum.

LEXICON bounds the voters' terms as SAMPLE bounds what is fitted; the scoring classifier reads all words of every text.

Defined cases: null or empty text has no hits and scores the classifier's bias; very long texts are read whole; no labels or
no toxic label: the lexicon is empty and all documents score low; a document labelled twice with different labels counts
as toxic; of rows that share a doc_id the one with the least text is learnt from, and each is scored; a null doc_id is
scored, never learnt from; terms that set texts apart equally are taken in byte order; an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import few, mix, small_batches, stored, table
from driftline.llm.linear import bounded, one_each, remainder, score, slots, train

SAMPLE, LEXICON, VOTERS = 16_000, 320, 16
BEGINNINGS = (5, 6, 7, 8, 9)
PATTERNS = 8
CLEAR = 2.3  # log odds ratio that a term needs
ROUNDS, DEPENDENT = 8, 0.25
PIECE = 1 << 16
BASE, SALT = 0x9E3779B97F4A7C15, np.uint64(0xD1B54A32D192ED03)
CAPITALS = bytes(range(65, 91))
#: ASCII other than letters and digits parts words; letters are lower-cased.
PARTS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def counted(text: str | None) -> Counter:
    return Counter((text or "").encode().translate(PARTS).split())


def terms(word: bytes) -> list[bytes]:
    """A word and its beginnings (marked by a star) that are shorter."""
    return [word, *(word[:k] + b"*" for k in BEGINNINGS if len(word) > k)]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE, and of its inverse modulo 2^64."""
    return np.cumprod(np.full(size, BASE, "u8")), np.cumprod(np.full(size, pow(BASE, -1, 1 << 64), "u8"))


POWERS = powers(2 * PIECE)


def term_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """data: words parted by spaces. (words by terms: 64-bit hashes of each word and of its beginnings; which of them exist)."""
    b = np.frombuffer(data, "u1")
    up, down = POWERS if len(b) <= len(POWERS[0]) else powers(len(b))
    edges = np.diff(np.concatenate([[0], b != 32, [0]]).astype("i1"))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    size = (end - start).astype("u8")
    sums = np.append(np.uint64(0), np.cumsum(b * up[: len(b)]))
    out = np.empty((len(start), 1 + len(BEGINNINGS)), "u8")
    out[:, 0] = (sums[end] - sums[start]) * down[start] + size * SALT
    padded = data + bytes(BEGINNINGS[-1])
    head = np.ndarray(len(b), "<u8", padded, strides=(1,))[start]  # the eight bytes from each start
    ninth = np.frombuffer(padded, "u1")[start + 8].astype("u8")
    for i, k in enumerate(BEGINNINGS, 1):
        part = head & np.uint64((1 << 8 * min(k, 8)) - 1)
        out[:, i] = (mix(part) + ninth if k > 8 else part) + np.uint64(k * int(SALT) % (1 << 64))
    return mix(out), size[:, None] > np.array((0, *BEGINNINGS), "u8")


def pieces(text: str | None) -> Iterator[bytes]:
    """The words of a text, parted by spaces, in pieces of some PIECE bytes (one longer word stays whole)."""
    data, at = (text or "").encode().translate(PARTS), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    parts = []
    for p in pieces(text):
        found, real = term_hashes(p)
        at = np.sort(slots(found[real]))
        first = np.flatnonzero(np.diff(at, prepend=-1))
        parts.append((at[first], np.diff(first, append=len(at))))
    at, n = parts[0] if parts else (np.zeros(0, "i4"), np.zeros(0, "i8"))
    if len(parts) > 1:
        at, place = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
        n = np.bincount(place, np.concatenate([m for _, m in parts]), len(at))
    return np.append(np.int32(0), at), np.append(np.float32(1), np.log2(1 + n).astype("f4"))


def lexicon(sample: DataFrame, size: int = LEXICON) -> list[bytes]:
    """sample: (text, y). The size terms that set toxic texts apart most, found in five of them or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for b in few(batches):
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                (toxic if y >= 0.5 else clean).update({x for w in counted(t) for x in terms(w)})
        if both := list(toxic.keys() | clean.keys()):
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.binary()), pa.array([toxic[w] for w in both], pa.int64()), pa.array([clean[w] for w in both], pa.int64())], ["term", "toxic", "clean"])

    totals = sample.agg(F.sum((F.col("y") >= 0.5).cast("long")), F.count("*")).first()
    toxic, clean = totals[0] or 0, totals[1] - (totals[0] or 0)
    sums = sample.select("text", "y").mapInArrow(run, "term binary, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    best = sums.filter("t >= 5").withColumn("s", odds).filter(F.col("s") > CLEAR).orderBy(F.desc(F.col("s") * F.log1p("t")), "term").limit(size)
    return [bytes(r.term) for r in best.select("term").collect()]  # size rows


YOU = term_hashes(b"you")[0][0, 0]


class Lexicon:
    """The voter of each term, by the term's hash."""

    def __init__(self, terms: list[bytes]):
        stems = {w: k for k, w in enumerate(dict.fromkeys(w[: BEGINNINGS[0]] for w in terms))}
        known = {hash_of(w): stems[w[: BEGINNINGS[0]]] % VOTERS for w in terms}
        self.hashes = np.array(sorted(known), "u8")
        self.voters = np.array([known[h] for h in sorted(known)], "i8")

    def find(self, found: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which words have a term here, the voters of all such terms)."""
        if not len(self.hashes):
            return np.zeros(len(found), bool), self.voters
        place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        met = real & (self.hashes[place] == found)
        return met.any(axis=1), self.voters[place[met]]


def hash_of(term: bytes) -> int:
    k = len(term) - 1 if term.endswith(b"*") else 0
    return int(term_hashes(term.rstrip(b"*"))[0][0, 1 + BEGINNINGS.index(k) if k else 0])


def cast_votes(text: str | None, known: Lexicon) -> bytes:
    """One byte a voter: 0 clean, 1 abstains, 2 toxic."""
    votes = np.ones(VOTERS + PATTERNS, "u1")
    hits, total, you, met = 0, 0, 0, np.zeros(0, "u8")
    for p in pieces(text):
        found, real = term_hashes(p)
        rows, voters = known.find(found, real)
        votes[voters] = 2
        hits, total, you = hits + int(rows.sum()), total + len(found), you + int((found[:, 0] == YOU).sum())
        met = np.unique(np.append(met, found[rows, 0]))
    text, kinds = text or "", len(met)
    data = text.encode()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    votes[VOTERS:] = [
        2 if kinds >= 4 else 1, 0 if not kinds else 1, 2 if kinds >= 2 else 1, 2 if hits * 50 >= total > 0 else 0 if hits * 400 <= total else 1,
        2 if capitals * 3 > len(text) > 0 else 1, 2 if text.count("!") * 20 > total > 0 else 1, 2 if you * 30 > total > 0 else 1, 0 if kinds <= 1 else 1,
    ]
    return votes.tobytes()


class LabelModel:
    """say[j, v, y]: chance that voter j says v given the class; part[j]: the share of its vote that is its own."""

    def __init__(self, voters: int):
        self.rate, self.part = 0.1, np.ones(voters)
        self.say = np.tile(np.array([[0.3, 0.1], [0.6, 0.5], [0.1, 0.4]]), (voters, 1, 1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ratio = np.log(self.say[:, :, 1] / self.say[:, :, 0]) * self.part[:, None]
        logit = np.log(self.rate / (1 - self.rate)) + ratio[np.arange(votes.shape[1]), votes].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))

    def sums(self, votes: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts: by class, by voter, vote and class, and products of centred votes by class."""
        out = []
        for q in (n * (1 - p), n * p):
            v = votes.astype("f8") - 1
            out += [[q.sum()], np.stack([(q[:, None] * (votes == k)).sum(axis=0) for k in range(3)], axis=1).ravel(), (v * q[:, None]).T.dot(v).ravel()]
        return np.concatenate(out)

    def update(self, sums: np.ndarray) -> None:
        j = len(self.part)
        size = 1 + 3 * j + j * j
        corr = np.zeros((j, j))
        for y in (0, 1):
            s = sums[y * size : (y + 1) * size]
            said, both = s[1 : 1 + 3 * j].reshape(j, 3), s[1 + 3 * j :].reshape(j, j)
            self.say[:, :, y] = (said + 1) / (s[0] + 3)
            mean = (said[:, 2] - said[:, 0]) / max(s[0], 1e-9)
            cov = both / max(s[0], 1e-9) - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            corr += np.abs(cov / np.outer(sd, sd)) / 2
        np.fill_diagonal(corr, 0)
        self.part = 1 / (1 + np.where(corr > DEPENDENT, corr, 0).sum(axis=1))
        self.rate = float(np.clip(sums[size] / max(sums[0] + sums[size], 1e-9), 1e-4, 0.5))


def fit_labels(votes: DataFrame, rounds: int = ROUNDS) -> LabelModel:
    """votes: stored (doc_id, votes), the label's vote last. The first round takes the labels for the classes."""
    model = LabelModel(VOTERS + PATTERNS + 1)
    shared: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, first, total = shared["model"], shared["first"], None
        for b in batches:
            v, n = as_array(b), b.column("n").to_numpy().astype("f8")
            if first:
                v, n = v[v[:, -1] != 1], n[v[:, -1] != 1]
            got = m.sums(v, n, (v[:, -1] == 2).astype("f8") if first else m.posterior(v))
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    same = stored(votes.groupBy("votes").agg(F.count("*").alias("n")), "toxicity-votes")
    for k in range(rounds + 1):
        shared |= {"model": model, "first": k == 0}
        if parts := [np.frombuffer(r.sums, "f8") for r in same.mapInArrow(run, "sums binary").collect()]:  # fixed size, one a task
            model.update(np.sum(parts, axis=0))
    return model


def as_array(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("votes").to_pylist()), "u1").reshape(-1, VOTERS + PATTERNS + 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = SAMPLE) -> np.ndarray:
    """learn: which rows may be learnt from. At most limit labelled rows make the lexicon, and at most limit documents
    the classifier; the label model is fitted to the votes of all rows in learn."""
    known = labels.filter(learn & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("double").alias("y"))
    texts = small_batches(docs).select(F.col("doc_id").cast("long"), "text")
    chosen = stored(bounded(known, limit), "toxicity-known")
    sample = stored(one_each(texts.join(F.broadcast(chosen), "doc_id")), "toxicity-sample")
    known_terms = Lexicon(lexicon(sample))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([cast_votes(t, known_terms) for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "votes"])

    cast = texts.filter(learn).mapInArrow(vote, "doc_id long, votes binary")
    label = F.when(F.col("y") >= 0.5, F.lit(b"\x02")).when(F.col("y") < 0.5, F.lit(b"\x00")).otherwise(F.lit(b"\x01"))
    votes = stored(cast.join(known.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id", "left").select("doc_id", F.concat("votes", label).alias("votes")), "toxicity-cast")
    model = fit_labels(votes)

    def believe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.posterior(as_array(b)), pa.float64())], ["doc_id", "y"])

    soft = stored(bounded(votes.groupBy("doc_id").agg(F.min("votes").alias("votes")), limit).mapInArrow(believe, "doc_id long, y double"), "toxicity-soft")
    return train(one_each(texts.join(F.broadcast(soft), "doc_id")), features, epochs=6, alpha=0.5, l1=1.0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = score(docs, model, features)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
