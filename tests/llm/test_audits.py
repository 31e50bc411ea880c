"""Source divergence, sequential verification and the dataset manifest against their plain versions."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from driftline.llm import common, divergence, manifest, minhash


@pytest.fixture(scope="module")
def hard(tmp_path_factory):
    docs, items, labels = brute.hard_rows()
    docs += [(10**6 + k, "\xe9t\xe9 Stra\xdfe x\u2019y \u65e5\u672c", lang, source, None) for k, (lang, source) in enumerate([(None, "a"), (None, None), ("", "a"), ("de", "only"), ("e\u0301n", "z")])]
    return docs, brute.write(tmp_path_factory.mktemp("hard"), docs, items, labels)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_op11(spark, hard, monkeypatch):
    docs, d = hard
    cols = ("lang", "source", "part", "item", "value", "rank")
    want = sorted(brute.divergences(docs))
    assert rows(divergence.op11_divergence(spark, d), *cols) == want and {r[2] for r in want} == {"pair", "term"}
    monkeypatch.setattr(divergence, "HELD", 40)
    monkeypatch.setattr(divergence, "PIECE", 50)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert rows(divergence.op11_divergence(spark, d), *cols) == want


def test_op11_counts_beyond_longs(spark):
    df = spark.createDataFrame([(5 * 10**11, 10**13), (0, 3 * 10**15)], "n long, total long")
    assert [r[0] for r in df.select(divergence.chance("n", "total")).collect()] == [1 + 10**9 * (n + 1) // t for n, t in ((5 * 10**11, 10**13), (0, 3 * 10**15))]


def known(rows):
    return sorted((r[0] is None, r[0] or 0, *map(str, r[1:])) for r in rows)


def rows_of(spark, docs, top=None):
    """documents of (doc_id, text, lang, source, n_chars) over some partitions."""
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def groups_of_copies(n: int) -> list[tuple]:
    """Groups of n near copies of a text, texts under one disclaimer, and texts just below the similarity."""
    rng = random.Random(5)
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    base, notice, third, docs = words(200), words(60), words(150), []
    for _ in range(n):
        copy = list(base)
        copy[rng.randrange(200)] = words(1)[0]
        copy[rng.randrange(200)] = words(1)[0]
        other = list(third)
        for k in rng.sample(range(150), 4):
            other[k] = words(1)[0]
        docs += [copy, notice + words(40), other]
    docs += [base, words(3), words(4), base + words(30)]
    return [(k, " ".join(w), None, None, None) for k, w in enumerate(docs)]


def test_op12(spark, hard):
    docs, d = hard
    docs = [*docs]
    got = minhash.op12_minhash(spark, d).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert known(got) == known(brute.near(docs)) and not all(r.kept for r in got)


def test_op12_null_and_shared_ids(spark):
    w = " ".join(f"w{k}" for k in range(50))
    docs = [(None, w, None, None, None), (5, w + " x", None, None, None), (5, "quite another text", None, None, None), (None, "alone here", None, None, None), (7, w, None, None, None), (7, w, None, None, None), (9, "  ", None, None, None), (8, None, None, None, None)]
    out = minhash.near_duplicates(rows_of(spark, docs)).collect()
    assert known((r.doc_id, r.n_shingles, r.component_id, False) for r in out) == known((a, b, c, False) for a, b, c, _ in brute.near(docs))


@pytest.mark.parametrize(("hot", "levels"), [(32, 2), (4, 2), (2, 1)])
def test_op12_crowded_bands(spark, monkeypatch, hot, levels):
    docs = groups_of_copies(60)
    monkeypatch.setattr(minhash, "LEVELS", minhash.LEVELS[:levels])
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0 if hot == 2 else 1 << 20)
    out = minhash.near_duplicates(rows_of(spark, docs), hot=hot).collect()
    want = brute.near(docs)
    assert known((r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in out) == known(want)
    assert max(sum(r[2] == c for r in want) for c in {r[2] for r in want}) > 50


def test_op12_pairs_below_the_similarity(spark, monkeypatch):
    """Copies of one text that are less similar than 0.8 share crowded buckets; their pairs don't reach the comparison."""
    rng, met = random.Random(5), []
    base = [f"b{k}" for k in range(150)]
    docs = []
    for k in range(240):
        copy = list(base)
        for at in rng.sample(range(150), 5):
            copy[at] = f"c{k}x{at}"
        docs.append((k, " ".join(copy), None, None, None))
        if k % 12 == 0:
            copy[75] = "other"
            docs.append((1000 + k, " ".join(copy), None, None, None))
    docs += [(2000 + k, " ".join([*base[: 150 - k], f"d{k}"]), None, None, None) for k in (1, 20)]
    prune = minhash.prune

    def counted(pairs, *more):
        met.append(pairs.distinct().count())
        return prune(pairs, *more)

    monkeypatch.setattr(minhash, "prune", counted)
    out = minhash.near_duplicates(rows_of(spark, docs)).collect()
    want = brute.near(docs)
    assert known((r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in out) == known(want)
    assert len({r[2] for r in want}) > 150 and sum(met[1:]) < minhash.HOT * len(docs)


def test_op12_posterior():
    from math import comb

    for n in (40, 120, 200):
        m, t = minhash.least_matches(n), 0.8 + 0.2 / 256
        tail = lambda k: sum(comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(k + 1))  # noqa: B023, E731
        assert tail(m) >= minhash.MISS > tail(m - 1)
        r = np.linspace(0, 1, 200_001)
        density = r**m * (1 - r) ** (n - m)
        assert abs(density[r >= t].sum() / density.sum() - tail(m)) < 0.02 * tail(m)


@pytest.mark.parametrize("fine", [False, True])
def test_op13(spark, hard, monkeypatch, fine):
    docs, d = hard
    docs = docs + [(10**7 + k, f"Text {k}", "xx", "s", k) for k in range(700)]
    docs += [(None, "A", None, None, None), (None, "A", None, None, 1), (3, "A", "xx", None, 1), (3, "B", "xx", None, 1)] + [(77, "Same", "xx", "s", 1)] * 40
    brute.write(d, docs, [], [])
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    if fine:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(manifest, "BLOCK", 1)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = manifest.op13_manifest(spark, d).select(*cols).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute.manifest(docs)
    assert known(got) == known(want) and {r[6] for r in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_op13_runs(n):
    """Runs that begin and end anywhere give the records of a whole tree, or edges that complete it."""
    leaves = [manifest.joined(str(k)) for k in range(n)]
    whole: list[tuple] = []
    stack = manifest.Range(n, whole)
    for k, x in enumerate(leaves):
        stack.push(0, k, x)
    stack.end()
    assert all(r[2] for r in whole if n > 1)
    for cut in {1, n // 3, n // 2 + 1, n - 1} - {0, n}:
        parts: list[tuple] = []
        for a, z in ((0, cut), (cut, n)):
            stack = manifest.Range(n, parts)
            for k in range(a, z):
                stack.push(0, k, leaves[k])
            stack.end()
        assert {r for r in parts if r[2]} <= set(whole) and sum(r[2] is None for r in parts) <= 2 * 8 * len(stack.widths)
