"""Each stage of the pipeline against its plain version, on what the stage before kept."""

from __future__ import annotations

import brute
import pytest
from test_near_copies import heads

import corpus_pipeline
from driftline.llm import packing, simhash, toxicity
from driftline.llm.common import stored, table


@pytest.fixture(scope="module")
def hard(tmp_path_factory):
    docs, items, labels = brute.hard_rows(2)
    return brute.write(tmp_path_factory.mktemp("pipe"), docs, items, labels)


def plain(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_stages(spark, hard):
    docs = table(spark, hard, "documents")
    f = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontaminate", "packing"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    one = stored(f["near_dedup"](spark, docs, hard), "one")
    assert one.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in one.collect()]
    assert sorted(d for d, _ in kept) == heads(rows) and len(kept) < len(set(rows))
    two = stored(f["suffix_dedup"](spark, one, hard), "two")
    assert two.columns == docs.columns
    cut = [(r.doc_id, r.text) for r in two.collect()]
    assert plain(cut) == plain(brute.without_repeats(kept)) and sum(len(t or "") for _, t in cut) < sum(len(t or "") for _, t in kept)
    assert [r.n_chars for r in two.collect()] == [None if r.text is None else len(r.text) for r in two.collect()]
    three = f["decontaminate"](spark, two, hard)
    assert three.columns == docs.columns
    items = [(r.item_id, r.text) for r in table(spark, hard, "benchmark").collect()]
    clean = plain(r for r, m in zip(cut, brute.leaks(cut, items), strict=True) if not m[5])
    assert plain((r.doc_id, r.text) for r in three.collect()) == clean and len(clean) < len(cut)
    got = f["packing"](spark, stored(three, "three"), hard).collect()
    vocabulary = packing.default_vocabulary()
    want = {d: len(packing.token_ids(t or "", vocabulary)) + 1 for d, t in clean}
    assert {r.doc_id for r in got} == set(want) and sum(r.length for r in got) == sum(want.values())
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(v) == [(sum(n for _, n in sorted(v)[:k]), n) for k, (_, n) in enumerate(sorted(v))] and sum(n for _, n in v) <= 1024 for v in by.values())


def test_stages_with_null_ids_and_clashing_columns(spark, tmp_path):
    a, b = (" ".join(f"{x}{k}" for k in range(120)) for x in "ab")
    docs = [(None, a, "en", None, 1), (1, a + " end", "en", None, 1), (None, b, None, None, None), (2, "short text", None, None, None), (2, "other text", None, None, None), (None, None, None, None, None), (3, "", None, None, None)]
    d = brute.write(tmp_path, docs, [(1, "other text"), (2, " ".join(b.split()[:12]))], [(1, 0, 0)])
    docs = table(spark, d, "documents").selectExpr("*", "1 as __spans__", "'x' as __id__", "2 as `key`", "3 as __row__")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, before = stored(stage(spark, docs, d), name), docs
        assert docs.columns == before.columns
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted([(1, a + " end"), (2, "short text"), (3, "")], key=str)


def test_toxic_documents_go_and_clean_ones_stay(spark):
    d = "/root/testdata/sf0.1"
    docs = table(spark, d, "documents")
    kept = corpus_pipeline.drop_toxic(spark, docs, d)
    labels = table(spark, d, "labels")
    stays = lambda y: kept.join(labels.filter(f"toxic = {y}"), "doc_id", "left_semi").count() / labels.filter(f"toxic = {y}").join(docs, "doc_id").count()
    assert stays(1) < 0.1 and stays(0) > 0.99


def test_whole_run(spark, hard, tmp_path):
    got = corpus_pipeline.run(spark, hard).collect()
    assert got and max(r.offset + r.length for r in got) <= 1024
    nothing = brute.write(tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (2, None), (3, "z y x w v")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, stored(docs, "d"), "").collect()) == [1, 2, 3]
    assert simhash.near_duplicates(docs).count() == 5 and toxicity.features(None)[0].tolist() == [0]
