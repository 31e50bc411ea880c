"""The pipeline's near copies against a comparison of all pairs."""

from __future__ import annotations

import brute
import pytest

import corpus_pipeline
from driftline.llm import near_copies
from driftline.llm.common import stored, table


def groups(rows: list[tuple]) -> dict[frozenset, list]:
    """Row numbers by component, all pairs compared."""
    sets = []
    for _, t, *_ in rows:
        w = brute.WORD.findall((t or "").translate(brute.UPPER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return out


def heads(rows: list[tuple]) -> list:
    return sorted(min(rows[i][0] for i in g) for g in groups(rows).values())


@pytest.mark.parametrize("hot", [1, 4, 32])
def test_equal_to_all_pairs(spark, tmp_path, hot):
    docs, items, labels = brute.hard_rows(2)
    docs = [(k, *r[1:]) for k, r in enumerate(docs)]
    d = brute.write(tmp_path, docs, items, labels)
    found = {}
    for r in near_copies.near_copies(table(spark, d, "documents"), hot).collect():
        found.setdefault(r.component, set()).add(r.doc_id)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups(docs).values()))


def test_stage_drops_near_copies_beyond_two_bits(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, d).collect())
    assert got == heads(rows)
    assert len(got) < len({c for _, _, c in brute.simhash(rows)})


def test_rows_that_share_a_doc_id_stay_if_their_texts_differ(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a, "en"), (1, b, "en"), (2, b, "de"), (None, c, "en"), (None, a + " tail", "en"), (3, c, "fr"), (1, a, "de"), (1, a, None)]
    for order in (rows, rows[::-1]):
        docs = stored(spark.createDataFrame(order, "doc_id long, text string, lang string"), "d")
        got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
        assert sorted(map(tuple, got), key=str) == sorted([(1, a, None), (1, b, "en"), (3, c, "fr")], key=str)
