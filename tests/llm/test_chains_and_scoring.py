"""Forward-backward against all paths; scores against a plain model."""

import itertools
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from edgeloom.llm import lm_scoring as M
from edgeloom.llm.chains import forward, forward_backward, side_by_side

SMALL = M.HmmSettings(states=3, head=40, own=20, suffixes=8, sample=50, sample_rounds=2, rounds=2)


@pytest.mark.parametrize("cells", [1, 13, 1000])
def test_against_all_paths(cells):
    r = np.random.default_rng(0)
    k, start, move, emit = 3, r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(5), 3)
    chains = [r.integers(0, 5, n) for n in (4, 1, 6, 0, 4, 2)]
    seen = []
    for own, items, running in side_by_side(chains, cells=cells):
        gamma, moves, logs = forward_backward(emit.T[items], running, start, move)
        _, again = forward(emit.T[items], running, start, move)
        assert np.allclose(logs, again)
        assert np.isclose(moves.sum(), sum(len(chains[i]) - 1 for i in own))
        for c, i in enumerate(own):
            seen.append(int(i))
            total, each = 0.0, np.zeros((len(chains[i]), k))
            for path in itertools.product(range(k), repeat=len(chains[i])):
                p = start[path[0]] * np.prod([move[a, b] for a, b in zip(path, path[1:])]) * np.prod([emit[s, o] for s, o in zip(path, chains[i])])
                total += p
                for t, s in enumerate(path):
                    each[t, s] += p
            assert np.isclose(np.log(total), logs[c]) and np.allclose(each / total, gamma[: len(chains[i]), c])
    assert sorted(seen) == [0, 1, 2, 4, 5]


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def test_scores(documents, words):
    import random

    rng = random.Random(3)
    halves = words[:60], words[60:120]
    texts = [(i, " ".join(rng.choices(halves[i % 2], k=rng.randint(0, 40)))) for i in range(300)]
    texts += [(400, None), (401, ""), (402, "\x0b Unknown É \x1f"), (403, "x" * 100_000 + " a"), *[(404, "Twice said")] * 2, (None, "no id")]
    rows = M.score_documents(documents(texts, extra="row_id classes words n"), settings=SMALL).collect()
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1
    counts = Counter(w for i, t in texts if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert all(r.train_tokens == n and r.held_out == held(r.doc_id) and math.isfinite(r.score) and r.score < 0 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_model_is_a_distribution(documents):
    """The chances of all texts of one word and the end, unknown words taken as one, add up with those of longer ones to 1."""
    texts = [(i, t) for i, t in enumerate(["a b", "b c a", "c", "a a b b", "d e f g"] * 8)]
    settings = M.HmmSettings(states=2, head=6, own=3, suffixes=2, sample=10, sample_rounds=1, rounds=2)
    docs = documents(texts)
    counts = M.count_words(docs.select("text"), settings)
    voc = M.read_vocabulary(counts, settings)
    table = {bytes(r.word): r.n for r in counts.collect()}
    share = Counter()
    for w, c in table.items():
        cls, _ = voc.head.get(w, (settings.suffix_class(w), 0))
        share[cls] += 1.0 if cls < settings.own else (c + 0.5) / voc.suffix_mass[cls]
    for cls in range(settings.own, settings.classes):
        share[cls] += 0.5 / voc.suffix_mass[cls]
    assert all(abs(share[c] - 1) < 1e-9 for c in share if share[c])
    model = M.first_guess(voc)
    assert np.allclose(model.emit.sum(axis=1), 1) and np.allclose(model.move.sum(axis=1), 1)


def test_rounds_raise_the_likelihood(documents, words):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    docs = documents([(i, " ".join(rng.choices(words[: 40 + 40 * (i % 2)], k=30))) for i in range(100)])
    voc = M.read_vocabulary(M.count_words(docs.select("text"), SMALL), SMALL)
    rows = docs.select(F.col("doc_id").alias("row_id"), "doc_id", F.lit(False).alias("held_out"), "text")
    encoded = M.stored(M.encode_texts(rows, voc), "test-encoded")
    model, logs = M.first_guess(voc), []
    for _ in range(4):
        logs.append(M.sequence_scores(encoded, model).agg({"chain": "sum"}).first()[0])
        model = M.baum_welch_round(encoded, model, voc)
    assert logs == sorted(logs)


def test_head_is_filled_from_words_of_one_count(documents):
    """Of equally frequent words that do not fit together, a share by hash makes up the head."""
    flat = documents([(0, " ".join(f"w{i}" for i in range(2000)))])
    settings = M.HmmSettings(states=2, head=1500, own=700, suffixes=8)
    counts = M.count_words(flat.select("text"), settings)
    head = M.read_vocabulary(counts, settings).head
    assert 1350 <= len(head) <= 1500 and sum(c < settings.own for c, _ in head.values()) == 700
    few = M.HmmSettings(states=2, head=2, own=2, suffixes=8)
    more = M.count_words(documents([(0, "often often twice twice " + " ".join(f"w{i}" for i in range(200)))]).select("text"), few)
    two = M.read_vocabulary(more, few).head
    assert set(two) == {b"often", b"twice"}


def word_model(docs, settings):
    """All steps of the operator, with what they leave behind: counts, vocabulary, encoded texts, other words, model."""
    rows = docs.selectExpr("doc_id as row_id", "doc_id", "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1 as held_out", "text")
    counts = M.count_words(rows.filter("not held_out").select("text"), settings)
    voc = M.read_vocabulary(counts, settings)
    encoded = M.stored(M.encode_texts(rows, voc), "test-encoded")
    tied = M.train(encoded, voc)
    expected = M.stored(M.expected_counts(encoded, tied, voc), "test-expected")
    others = M.stored(M.other_words(expected, settings.states), "test-others")
    return {bytes(r.word): r.n for r in counts.collect()}, voc, encoded, tied, others, M.untie(expected, others, tied, voc)


def test_words_part_in_the_last_round(documents, words):
    """Every training word has the emissions of a plain expectation step, and scores follow from them by all paths."""
    import random

    rng = random.Random(11)
    settings = M.HmmSettings(states=2, head=12, own=5, suffixes=4, sample=30, sample_rounds=2, rounds=1)
    long = "Z" * 70
    texts = {i: " ".join(rng.choices([*words[50 * (i % 2) : 50 * (i % 2) + 40], *[long] * 5], k=rng.randint(0, 9))) for i in range(120)}
    texts[500] = "never seen before " + long
    docs = documents(list(texts.items()))
    counts, voc, encoded, tied, others, model = word_model(docs, settings)
    assert M.head_key(long.lower().encode()) in voc.head
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tail = 1.0 / np.where(voc.suffix_mass > 0, voc.suffix_mass, 1)

    def tied_emission(w):
        cls, _ = voc.head.get(M.head_key(w), (settings.suffix_class(w), 0))
        return tied.emit[:, cls] * (1.0 if cls < settings.own else (counts.get(w, 0) + 0.5) * tail[cls])

    want = {w: np.zeros(2) for w in counts}
    for i, text in texts.items():
        if not held(i):
            seq = tokens(text)
            [(_, items, running)] = side_by_side([np.arange(len(seq))])
            gamma, _, _ = forward_backward(np.array([tied_emission(w) for w in seq])[items], running, tied.start, tied.move)
            for t, w in enumerate(seq):
                want[w] += gamma[t, 0]
    totals = sum(want.values())
    assert np.allclose(model.totals, totals, rtol=5e-3)
    emission = lambda w: 0.5 * tied_emission(w) + 0.5 * want.get(w, 0) / totals
    for at, key in enumerate(voc.head):
        w = key if len(key) <= 64 and not (key[:1] == b"\n" and len(key) > 1) else long.lower().encode()
        assert np.allclose(model.head[at], emission(w), rtol=1e-2)
    assert len(counts) > len(voc.head) + 20
    for r in M.word_scores(encoded, others, model, voc).collect():
        seq = tokens(texts[r.doc_id])
        logs = []
        for path in itertools.product(range(2), repeat=len(seq)):
            p = model.start[path[0]] * np.prod([model.move[a, b] for a, b in zip(path, path[1:])])
            logs.append(p * np.prod([emission(w)[s] for s, w in zip(path, seq)]))
        assert math.isclose(r.score, math.log10(sum(logs)), abs_tol=0.01 * len(seq))


def test_word_emissions_are_a_distribution(documents, words):
    """In each state the words of the vocabulary and the unknown ones together have the chance 1."""
    settings = M.HmmSettings(states=3, head=10, own=4, suffixes=2, sample=20, sample_rounds=1)
    counts, voc, encoded, tied, others, model = word_model(documents([(i, " ".join(words[i % 7 : i % 7 + 30])) for i in range(60)]), settings)
    total = model.head.sum(axis=0)
    found = {}
    listed = {(r.row_id, at): bytes(w) for r in encoded.collect() for at, w in enumerate(r.words)}
    for r in others.collect():
        found[listed[r.row_id, r.pos]] = (r.n, r.shares)
    assert set(found) == set(counts) - set(voc.head) and len(found) > 10
    for w, (n, shares) in found.items():
        assert n == counts[w]
        total = total + model.others(voc, np.array([settings.suffix_class(w)]), np.array([n]), np.array([shares]))[0]
    classes = np.arange(settings.own, settings.classes)
    total = total + model.others(voc, classes, np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)).sum(axis=0)
    assert np.allclose(total, 1)


def test_a_flat_vocabulary_has_states_for_all_words(documents):
    """No word of a flat vocabulary is left to the tied classes."""
    docs = documents([(i, " ".join(f"w{j}" for j in range(200))) for i in range(20)])
    counts, voc, _, _, others, _ = word_model(docs, M.HmmSettings(states=2, head=150, own=100, suffixes=8))
    assert others.select("row_id", "pos").distinct().count() == 20 * (len(counts) - len(voc.head))
    assert len(counts) == 201 and len(voc.head) <= 150


def test_counts_know_the_class_of_each_word(documents):
    rows = M.count_words(documents([(0, "a é ab éé abé abcé \u0e01\u0e02 longer \U0001f600x")]).select("text"), SMALL).collect()
    assert len(rows) == 10 and all(r.suffix == SMALL.suffix_class(bytes(r.word)) and r.n == 1 for r in rows)


def test_empty_and_untrained(documents):
    assert M.score_documents(documents([]), settings=SMALL).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = M.score_documents(documents([(only, "a b")]), settings=SMALL).first()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and math.isfinite(row.score)


def test_first_rounds_go_over_all_training_texts(documents, monkeypatch):
    """The shares of the first rounds are disjoint and together all training texts, few or many."""
    from pyspark.sql import functions as F

    docs = documents([(i, "w" + " w" * i) for i in range(90)])
    rows = docs.select(F.col("doc_id").alias("row_id"), "doc_id", (F.col("doc_id") % 5 == 1).alias("held_out"), "text")
    voc = M.read_vocabulary(M.count_words(rows.filter("not held_out").select("text"), SMALL), SMALL)
    encoded = M.stored(M.encode_texts(rows, voc), "test-encoded")
    wanted = sorted(i + 2 for i in range(90) if i % 5 != 1)
    plain, seen = M.baum_welch_round, []

    def watched(part, model, vocabulary):
        seen.append([len(r.classes) // 2 for r in part.select("classes").collect()])
        return plain(part, model, vocabulary)

    monkeypatch.setattr(M, "baum_welch_round", watched)
    for sample, shares in ((6, 3), (30, 2), (2000, 1)):
        seen.clear()
        settings = M.HmmSettings(states=2, head=SMALL.head, own=SMALL.own, suffixes=SMALL.suffixes, sample=sample, sample_rounds=3)
        M.train(encoded, M.Vocabulary(settings, voc.head, voc.total, voc.distinct, voc.suffix_mass, voc.class_counts))
        assert len(seen) == 4 and sorted(seen[3]) == wanted
        assert sorted(n for part in seen[:shares] for n in part) == wanted


def test_every_round_goes_over_all_training_texts(documents, monkeypatch):
    """With the settings of the operator no round is over a share of the texts, however many there are."""
    from pyspark.sql import functions as F

    settings = M.HmmSettings(states=2, head=SMALL.head, own=SMALL.own, suffixes=SMALL.suffixes)
    rows = documents([(i, "w x") for i in range(6000)]).select(F.col("doc_id").alias("row_id"), "doc_id", (F.col("doc_id") % 5 == 1).alias("held_out"), "text")
    voc = M.read_vocabulary(M.count_words(rows.filter("not held_out").select("text"), settings), settings)
    encoded = M.stored(M.encode_texts(rows, voc), "test-encoded")
    seen = []

    def watched(part, model, vocabulary):
        seen.append(part.count())
        return model

    monkeypatch.setattr(M, "baum_welch_round", watched)
    M.train(encoded, voc)
    assert seen == [4800] * (settings.sample_rounds + settings.rounds)


def test_the_recursions_hold_two_arrays():
    rng = np.random.default_rng(3)
    emit, move = rng.random((50, 8)), rng.random((8, 8))
    sequences = [rng.integers(0, 50, n) for n in rng.integers(1, 400, 900)]
    assert all(items.size <= 150_000 for _, items, _ in side_by_side(sequences))
    _, items, running = next(side_by_side(sequences))
    potentials = emit[items]
    tracemalloc.start()
    gamma, _, _ = forward_backward(potentials, running, np.full(8, 1 / 8), move / move.sum(axis=1, keepdims=True))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    lengths = (running[:, None] > np.arange(items.shape[1])).sum(axis=0)
    assert np.allclose(gamma.sum(axis=(0, 2)), lengths)
    assert peak < 1.6 * potentials.nbytes


def test_encoded_texts_hold_each_word_once(documents):
    """Words with a class of their own are stored as that class alone, and all words of a text follow from what is stored."""
    from pyspark.sql import functions as F

    texts = ["a a b", "a b c d e f g", "new a newer new", "", None, "z" * 70 + " a"]
    settings = M.HmmSettings(states=2, head=6, own=3, suffixes=4)
    rows = documents(list(enumerate(texts))).select(F.col("doc_id").alias("row_id"), "doc_id", F.lit(False).alias("held_out"), "text")
    voc = M.read_vocabulary(M.count_words(rows.filter("doc_id < 2").select("text"), settings), settings)
    place = {w: i for i, w in enumerate(voc.head)}
    for r in M.encode_texts(rows, voc).collect():
        classes = np.frombuffer(r.classes, "<u2")
        items = M._items(classes, bytes(r.rest), settings.own)
        listed = list(map(bytes, r.words))
        assert [list(voc.head)[i] if i >= 0 else listed[-1 - i] for i in items] == M.words_of(texts[r.row_id])
        assert M._suffixes(classes, items, len(listed)).tolist() == [settings.suffix_class(w) for w in listed]
        own = [place.get(w, settings.own) < settings.own for w in M.words_of(texts[r.row_id])]
        assert all(own) == (not r.rest) and (classes < settings.own).tolist() == own
