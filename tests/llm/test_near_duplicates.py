"""MinHash groups and line deduplication against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from edgeloom.llm import line_dedup as D
from edgeloom.llm.components import components
from edgeloom.llm.minhash_dedup import MinHashSettings, forest_links, near_duplicates, one_of_each_group

ODD = [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one two"), (5004, "One  TWO"), (5005, "x " * 100_000), (5006, "é É"), (5007, "É é")]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {n: root(n) for n in nodes}


def families(words, seed, n=6, size=25):
    """Texts with copies, edited copies, and a passage many of them share."""
    rng = random.Random(seed)
    passage = rng.choices(words, k=40)
    texts = []
    for _ in range(n):
        base = rng.choices(words, k=rng.randint(30, 150))
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    texts += [" ".join(rng.choices(words, k=20) + passage + rng.choices(words, k=20)) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def brute(texts, percent=85):
    sets = [(i, shingles(t)) for i, t in texts if i is not None]
    links = [(i, j) for a, (i, s) in enumerate(sets) for j, t in sets[a + 1 :] if s and 100 * len(s & t) >= percent * len(s | t)]
    return roots({i for i, _ in sets}, links)


@pytest.mark.parametrize("settings", [MinHashSettings(), MinHashSettings(list_block=8, set_block=5)])
def test_groups(documents, words, settings):
    texts = families(words, 1) + ODD
    rows = near_duplicates(documents(texts, extra="rep h1 component shared token"), settings).collect()
    want = brute(texts)
    assert len(rows) == len(texts)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(shingles(t)) for i, t in texts}


def test_repeated_and_missing_ids(documents):
    text = "a b c d e f g h"
    rows = near_duplicates(documents([(7, text), (7, text), (7, "something else here"), (9, text), (8, "something else here"), (None, text)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), str(r.kept)) for r in rows) == sorted(
        [("7", "7", "True")] * 3 + [("9", "7", "False"), ("8", "7", "False"), ("None", "None", "None")]
    )
    assert near_duplicates(documents([])).collect() == []


def test_one_of_each_group(documents, words):
    texts = families(words, 2, n=3) + ODD + [(3, "again"), (None, "no id"), (None, None)]
    docs = documents(texts, extra="gone __id")
    left = one_of_each_group(docs)
    assert left.columns == docs.columns
    want = {i for i, r in brute([t for t in texts if t != (3, "again")]).items() if i == r}
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


def test_components(spark):
    rng = random.Random(3)
    nodes = list(range(300))
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 200)]
    want = roots(set(nodes) | {n for pair in links for n in pair}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: want[n] for n in {n for a, b in links if a != b for n in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("apart", [False, True])
def test_forest_joins_what_all_links_join(apart):
    r = np.random.default_rng(1)
    link = r.random((60, 60)) < 0.03
    link |= link.T
    low = np.arange(60) < 25 if apart else np.ones(60, dtype=bool)
    every = [(i, j) for i in range(60) for j in range(60) if link[i, j] and i != j and (not apart or low[i] != low[j])]
    found = forest_links(60, low, lambda i, others: link[i, others])
    assert roots(range(60), found) == roots(range(60), every) and len(found) < 60


def diff_is_common(a, b):
    pairs = D.patience_pairs(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    return pairs


def test_patience():
    assert diff_is_common([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert diff_is_common([9, 1, 2, 3, 8], [7, 1, 2, 3]) == [(1, 1), (2, 2), (3, 3)]
    assert diff_is_common([1, 5, 2, 5, 3], [1, 5, 9, 2, 5, 3]) == [(0, 0), (1, 1), (2, 3), (3, 4), (4, 5)]
    assert diff_is_common([], [1]) == []
    rng = random.Random(1)
    for _ in range(200):
        diff_is_common(rng.choices(range(12), k=15), rng.choices(range(12), k=15))
    assert D.common_blocks([1, 2, 3, 4], [3, 4, 9, 1, 2], [5] * 5, 10) == [(0, 2), (3, 5)]
    assert D.common_blocks([1, 2, 3], [1, 9, 3], [5] * 3, 10) == []


def brute_cut(texts, least=10):
    """Stretches of lines that an earlier document holds in the same order, all of them, by a plain search."""
    split = [(i, t, (t or "").split("\n")) for i, t in texts]
    out = {}
    for i, t, lines in split:
        gone = set()
        for j, _, other in split:
            if j < i:
                for a in range(len(lines)):
                    for b in range(len(other)):
                        k = 0
                        while a + k < len(lines) and b + k < len(other) and lines[a + k] == other[b + k] and lines[a + k]:
                            k += 1
                        if sum(len(x.split()) for x in lines[a : a + k]) >= least:
                            gone.update(range(a, a + k))
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone) if gone else t
    return out


def test_line_dedup(documents, words):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choices(words, k=rng.randint(4, 12)))
    passages = [[line() for _ in range(rng.randint(1, 5))] for _ in range(6)]
    common = " ".join(rng.choices(words, k=12))
    texts = []
    for i in range(60):
        parts = [[line()] for _ in range(4)] + rng.sample(passages, rng.choice([0, 1, 2])) + [[common]] * (i % 3 == 0)
        rng.shuffle(parts)
        texts.append((i, "\n".join(x for p in parts for x in p)))
    rows = D.remove_common_lines(documents(texts, extra="doc cut early"), count="n").collect()
    want = brute_cut(texts)
    assert {r.doc_id: r.text for r in rows} == want
    for r in rows:
        assert r.n == (dict(texts)[r.doc_id].count("\n") + 1 - (r.text.count("\n") + 1 if r.text else 0))


def test_line_dedup_odd_rows(documents):
    long_line = "one two three four five six seven eight nine ten eleven"
    texts = [
        (None, long_line), (1, None), (2, ""), (3, f"mine\n{long_line}\n\nend"), (3, f"mine\n{long_line}\n\nend"), (4, f"  {long_line} \nshort"),
        (5, "a\n" * 50_000 + long_line), (6, "short\nshort"), (7, "\n\n"), (8, long_line.upper()),
    ]
    docs = documents(texts, extra="n_cut")
    rows = D.remove_common_lines(docs).collect()
    assert D.remove_common_lines(docs).columns == docs.columns
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r.text)
    assert by == {None: [long_line], 1: [None], 2: [""], 3: ["mine\n\nend"] * 2, 4: ["short"], 5: ["a\n" * 49_999 + "a"], 6: ["short\nshort"], 7: ["\n\n"], 8: [long_line.upper()]}
    assert D.remove_common_lines(documents([])).collect() == []


def test_line_dedup_of_frequent_lines(documents):
    """Short frequent lines that each first occur alone: the block they form is cut from all but its first holder."""
    block = ["one two three four five six", "seven eight nine ten eleven"]
    texts = [(0, f"own a\n{block[0]}"), (1, f"own b\n{block[1]}"), *[(i, "\n".join([f"own {i}", *block, f"end {i}"])) for i in range(2, 14)]]
    assert {r.doc_id: r.text for r in D.remove_common_lines(documents(texts)).collect()} == brute_cut(texts)
    # A line that is long enough alone has another first holder than the block it ends.
    long_line = " ".join("abcdefghij")
    texts = [(0, long_line), *[(i, f"own {i}\n{long_line}\nshort tail\nend {i}") for i in range(1, 12)], (12, f"tail\nshort tail\n{long_line}"), (13, f"x\nshort tail\n{long_line}")]
    assert {r.doc_id: r.text for r in D.remove_common_lines(documents(texts)).collect()} == brute_cut(texts)


def test_line_dedup_of_repeated_passages(documents):
    """A passage that the first holder or a later one has twice leaves no anchor that is unique in both."""
    passage = ["one two three four five six", "seven eight nine ten eleven"]
    assert D.common_blocks([1, 2, 9, 1, 2, 8], [7, 1, 2, 6], [5] * 4, 10) == [(1, 3)]
    assert D.common_blocks([9, 1, 2, 8], [7, 1, 2, 6, 1, 2, 5], [5] * 7, 10) == [(1, 3), (4, 6)]
    for twice in (0, 1, 2):
        texts = [(i, "\n".join([f"own {i}", *passage, *([f"mid {i}", *passage] if i == twice or i == 20 else []), f"end {i}"])) for i in [0, 1, 2, *range(11, 24)]]
        assert {r.doc_id: r.text for r in D.remove_common_lines(documents(texts)).collect()} == brute_cut(texts)


def held_runs(lines, words, least=10):
    """All stretches of adjacent lines that have enough words and are no longer than they must be, by a plain search."""
    out = {}
    for i in range(len(lines)):
        for k in range(i + 1, len(lines) + 1):
            if sum(words[i:k]) >= least:
                out.setdefault(tuple(lines[i:k]), []).append((i, k))
                break
    return out


def test_only_aligned_blocks_go():
    """Two runs that overlap in the later document stand apart in the earlier: one is aligned, the rest of the other stays."""
    assert D.common_blocks([1, 2, 9, 2, 3], [1, 2, 3], [6] * 3, 10) == [(0, 2)]
    assert D.common_blocks([1, 2, 9, 2, 3, 4], [1, 2, 3, 4], [6] * 4, 10) == [(0, 4)]
    assert D.common_blocks([5] * 40, [5] * 30, [3] * 30, 10) == [(0, 30)]
    assert D.common_blocks([], [1], [20], 10) == D.common_blocks([1], [], [], 10) == []


def test_blocks_are_aligned_and_whole():
    """Each block is a chain of stretches of the earlier document; no run of it is left whole in the later one."""
    rng = random.Random(12)
    size = [0, 3, 4, 5, 6, 7, 4, 11]
    for _ in range(1500):
        a, b = (rng.choices(range(8), k=rng.randint(0, 14)) for _ in range(2))
        words = [size[x] for x in b]
        blocks = D.common_blocks(a, b, words, 10)
        gone = [any(x <= p < y for x, y in blocks) for p in range(len(b))]
        known, own = held_runs(a, [size[x] for x in a]), held_runs(b, words)
        for run, places in own.items():
            if run in known:
                assert all(any(gone[i:k]) for i, k in places)
        covered = {p for x in range(len(b)) for y in range(x + 1, len(b) + 1) for z in range(len(a)) if a[z : z + y - x] == b[x:y] and sum(words[x:y]) >= 10 for p in range(x, y)}
        assert all(p in covered for p in range(len(b)) if gone[p])


def test_line_dedup_of_mixed_runs(documents):
    """Each document is cut by its alignments with the first holders of its runs."""
    rng = random.Random(8)
    lines = [" ".join(f"{c}{k}" for k in range(n)) for c, n in zip("abcdefg", (3, 4, 5, 6, 7, 4, 11))]
    split = {i: [f"own {i}", *rng.choices(lines, k=rng.randint(0, 9))] for i in range(60)}
    count = {i: [len(x.split()) for x in t] for i, t in split.items()}
    number = {x: n for n, x in enumerate(sorted({x for t in split.values() for x in t}))}
    as_numbers = {i: [number[x] for x in t] for i, t in split.items()}
    back = {i: held_runs(t[::-1], count[i][::-1]) for i, t in split.items()}
    held = {i: set(held_runs(t, count[i])) | {r[::-1] for r in back[i]} for i, t in split.items()}
    first = {r: min(i for i in held if r in held[i]) for t in held.values() for r in t}
    want = {}
    for i, t in split.items():
        gone = set()
        for j in {first[r] for r in held[i]} - {i}:
            gone.update(p for x, y in D.common_blocks(as_numbers[j], as_numbers[i], count[i], 10) for p in range(x, y))
        want[i] = "\n".join(x for p, x in enumerate(t) if p not in gone)
    texts = [(i, "\n".join(t)) for i, t in split.items()]
    assert {r.doc_id: r.text for r in D.remove_common_lines(documents(texts)).collect()} == want


def test_ids_over_several_texts_are_one_node(documents, words):
    """Rows (7, b), (8, b), (8, c), (9, c) are one group, also with chains over more texts and rows without words."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(12)]
    rows = [(7, texts[0]), (8, texts[0]), (8, texts[1]), (9, texts[1]), (9, ""), (8, None), (4, "")]
    ids = rng.sample(range(100, 200), 20)
    rows += [(rng.choice(ids), texts[rng.randrange(2, 12)]) for _ in range(24)]
    links = [(a, b) for a, s in rows for b, t in rows if a < b and s and s == t]
    want = roots({i for i, _ in rows}, links)
    got = near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)
