"""Search against plain loops, and the graph of shared sums against sums per item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from edgeloom.llm.lexical_search import QueryGraph, SearchSettings, rank_documents, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain(docs, items, top=20):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    bags = {}
    for i, t in dict.fromkeys(items):
        bags.setdefault(i, Counter()).update(plain_terms(t))
    out = []
    for item, bag in bags.items():
        scored = []
        for doc, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n // length
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in bag.items() if c[t])
            scored.append((s, doc))
        scored.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
        out += [(item, r, doc, s) for r, (s, doc) in enumerate([x for x in scored if x[0] > 0][:top], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS term", "2 AS n", "3 AS `a.b`")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS score", "2 AS rank")
    return sorted((tuple(r) for r in rank_documents(d, i, **more).collect()), key=repr)


@pytest.mark.parametrize("settings", [SearchSettings(), SearchSettings(item_bytes=200, cells=90)])
def test_against_loops(spark, words, settings):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(words[:60], k=rng.randint(1, 80)))) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # more equal documents than there are places
    docs += [docs[3], docs[3], (None, docs[3][1]), (None, None), (5000, None), (5001, ""), (5002, "-- __ ..")]
    docs += [(6000, "Éa éa ÉA_x-1 A\x00b 𝒜z" + " tail" * 5000), (6001, "ÉA")]
    items = [(i, " ".join(rng.choices(words[:70], k=rng.randint(1, 30)))) for i in range(25)]
    items += [items[0], (1, "Éa 𝒜Z a b ÉA tail tail"), (90, None), (91, ""), (92, "unheardof"), (None, "x 1")]
    assert got(spark, docs, items, settings=settings) == plain(docs, [x for x in items if x[1] is not None])


def test_empty(spark):
    assert got(spark, [], [(1, "a")]) == [] and got(spark, [(1, "a")], []) == [] and got(spark, [(1, None)], [(1, "a")]) == []


def test_terms():
    for text in ("Ab_c d-É9 İ​x", "", None, "".join(map(chr, range(0x180)))):
        assert [t.decode() for t in terms_of(None if text is None else text.encode())] == plain_terms(text)


def test_shared_sums_are_made_once(words):
    rng = random.Random(5)
    shared = rng.sample(words, 30)
    bags = [Counter(shared + rng.choices(words, k=5)) for _ in range(20)]
    graph = QueryGraph(bags)
    values = np.array([[rng.randrange(1000) for _ in range(4)] for _ in graph.terms])
    value = dict(zip(graph.terms, values, strict=True))
    for bag, sums in zip(bags, graph.sums(values), strict=True):
        assert (sums == sum(n * value[t] for t, n in bag.items())).all()
    additions = sum(len(a) for a, _ in graph.rounds) + sum(len(x) for x in graph.items)
    assert additions < 0.4 * sum(b.total() for b in bags)
