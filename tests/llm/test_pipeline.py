"""The stages one by one, each against what it was given, and the guard of the entry."""

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from tests.llm.test_near_duplicates import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark):
    from edgeloom.llm.common import stored, table

    tables = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), f"test-{name}"))
    return tables


def test_stages(written):
    given, tagged, cut, single, packed = written
    assert [t.columns for t in (tagged, cut, single)] == [given.columns] * 3
    texts = {r.doc_id: r.text for r in given.collect()}
    assert {r.doc_id: r.text for r in tagged.collect()} == {i: t for i, t in texts.items() if any(c.isalpha() for c in t)}
    after = {r.doc_id: r for r in cut.collect()}
    assert set(after) <= set(texts)
    assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text != texts[i])
    assert {r.doc_id for r in single.collect()} == {i for i, c in brute([(i, r.text) for i, r in after.items()], 80).items() if i == c}
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in single.select("doc_id").collect()}


def test_registered():
    assert [n for n in queries() if n.startswith("op") or n == "pipeline"] == [
        "op1_sharding", "op2_hmm_scoring", "op3_best_fit_packing", "op4_language_id", "op5_voronoi_topk", "op6_url_filter", "op7_line_dedup",
        "op8_sentencepiece", "op9_minhash_dedup", "op10_embedding_dedup", "op11_prefix_trie", "op12_shared_search", "op13_min_cut_html", "pipeline",
    ]


def test_odd_documents(spark, documents):
    rows = [(1, None, None), (2, "", None), (None, "no id but words", "en"), (3, "words " * 50_000, "en"), *[(4, "some words here", "en")] * 3]
    for table in (documents([]), documents(rows)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_near_duplicates_from_080(spark, documents, words):
    """The stage links from 0.80 on, as a brute-force search does."""
    import random

    from tests.llm.test_near_duplicates import roots, shingles

    rng = random.Random(12)
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=120)
        texts.append(base)
        texts.append([*base[:rng.randint(96, 112)], *rng.choices(words, k=8)])
    texts = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [(i, shingles(t)) for i, t in texts]
    alike = {(i, j): len(s & t) / len(s | t) for a, (i, s) in enumerate(sets) for j, t in sets[a + 1 :]}
    assert sum(0.8 <= x < 0.85 for x in alike.values()) > 3
    want = roots([i for i, _ in sets], [p for p, x in alike.items() if x >= 0.8])
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(texts), SF).collect()}
    assert left == {i for i, c in want.items() if i == c}
