"""Held-out accuracy, code-switched text, gradient, odd rows."""

import random

import pytest

from edgeloom.llm import language_id as L
from edgeloom.llm.common import ARROW_ROWS, TEXTS_AT_ONCE, in_small_batches

LETTERS = {"en": "th he in er an on", "de": "sch ei ü ung ch tz", "fr": "eau é ç oi qu eux"}
SMALL = L.CrfSettings(sample=120, rounds=15, width=4096)


def sentence(lang, n, rng):
    return " ".join("".join(rng.choices(LETTERS[lang].split(), k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return [(i, sentence(lang := rng.choice(list(LETTERS)), rng.randint(3, 40), rng), lang) for i in range(400)]


def test_held_out_accuracy_and_odd_rows(documents, texts):
    odd = [(1000, None, "en"), (1001, "", None), (1002, "12 !? 345", "de"), (1003, "the " * 100_000, None), (None, "eau eux", None), *[(1004, "sch ung", None)] * 2]
    rows = L.identify_languages(documents(texts + odd, extra="lang_pred score"), SMALL).collect()
    truth = {i: lang for i, _, lang in texts}
    assert len(rows) == len(texts) + len(odd)
    out = [r for r in rows if r.doc_id in truth and r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)
    said = {r.doc_id: r.lang_pred for r in rows}
    assert [said[i] for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "en", "fr", "de"]


def test_labels_words_of_switching_text(documents, texts):
    rng = random.Random(2)
    crf = L.fit([(t, lang) for _, t, lang in texts], SMALL)
    mixed = sentence("en", 20, rng) + " " + sentence("fr", 15, rng) + " " + sentence("de", 25, rng)
    row = L.tag_documents(documents([(1, mixed)]), crf, spans=True).first()
    labels = [s.lang for s in row.spans for _ in range(s.start, s.end)]
    want = ["en"] * 20 + ["fr"] * 15 + ["de"] * 25
    assert len(labels) == 60 and sum(a == b for a, b in zip(labels, want)) >= 55


def test_accepted_keeps_rows(documents, texts):
    crf = L.fit([(t, lang) for _, t, lang in texts], SMALL)
    docs = documents([*texts[:50], (900, "123", "en"), (901, None, "en"), (902, "", "en")], extra="score")
    kept = L.accepted(docs, crf)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in texts[:50]}


def test_no_or_one_language(documents):
    assert L.identify_languages(documents([])).collect() == []
    assert {r.lang_pred for r in L.identify_languages(documents([(i, "a word", None) for i in range(5)])).collect()} == {"und"}
    assert {r.lang_pred for r in L.identify_languages(documents([(i, "a word", "xx") for i in range(20)])).collect()} == {"xx"}


def test_letters():
    assert [L.letters(w) for w in ("word", "'word'!", "###", "a1b", "é***", "")] == ["word", "word", "", "a1b", "é", ""]


def test_long_and_copied_training_texts(documents):
    """Long texts are learnt from by a stretch, copies of one text count once, and without labels no clean document goes."""
    from pyspark.sql import functions as F

    from edgeloom.llm import language_id as L

    long_text = "der hund und die katze " * 2_000
    rows = [(4 * i, "the very same text of many copies", "en") for i in range(40)] + [(4 * i + 1, f"another english text number {i} here", "en") for i in range(5)]
    docs = documents([*rows, *[(4 * i, f"{i} {long_text}", "de") for i in range(3)]])
    chosen = L.labelled_sample(docs, "text", "lang", F.lit(True), L.CrfSettings(sample=20))
    assert sorted(lang for _, lang in chosen) == ["de"] * 3 + ["en"] * 6 and len(set(chosen)) == 9
    assert all(len(t) == 20_000 for t, lang in chosen if lang == "de")
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert L.accepted(none, L.fit_on_documents(none)).count() == docs.count()
    assert L.accepted(docs, L.fit_on_documents(docs)).filter("lang = 'de'").count() == 3


def test_texts_go_to_python_in_small_batches(documents):
    """A batch of whole texts is held by the JVM and by the worker; ten thousand of them at once were too many."""
    docs = documents([(i, t) for i, t in enumerate(["die katze", "1"])])
    conf = docs.sparkSession.conf
    before = conf.get(ARROW_ROWS)
    try:
        for held, want in (("10000", str(TEXTS_AT_ONCE)), ("0", str(TEXTS_AT_ONCE)), ("7", "7")):
            conf.set(ARROW_ROWS, held)
            assert in_small_batches(docs).count() == 2 and conf.get(ARROW_ROWS) == want
        conf.set(ARROW_ROWS, "10000")
        L.accepted(docs, L.fit([]))
        assert conf.get(ARROW_ROWS) == str(TEXTS_AT_ONCE)
    finally:
        conf.set(ARROW_ROWS, before)
