"""The trie against plain dictionaries, and the scan against plain sums."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from edgeloom.llm.prefix_trie import BASES, PRIME, Scan, TrieSettings, placed_turns, prefix_trie, times


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables would be put together in one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends, below = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                below[turns[: d - 1]].add(turns[:d])
    out = []
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in below[node]) if below[node] else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[x] for x in below[node])
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below[node]), leaves[node], saved[node], sha))
    return sorted(out, key=repr)


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.selectExpr("*", "1 AS depth", "2 AS place", "3 AS `a.b`", "4 AS k1")
    return sorted((tuple(r) for r in prefix_trie(df, **more).collect()), key=repr)


def rows_of(seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", None, ""], ["", "a", "bé", "𝒜 c", None, "long " * 50]
    rows = []
    for c in rng.sample(range(-350, 350), 60):
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(roles[:2]), rng.choice(texts[:3])))
    for c in (0, 1, 101, 205, 300):  # ties, repeated rows, null turns
        rows += [(c, None, rng.choice(roles), rng.choice(texts)) for _ in range(4)] + [(c, 3, "user", "a")] * 3
    rows += [(None, 1, "user", "x"), (None, None, None, None), (10**12 + 7, None, None, None)]
    return rows


@pytest.mark.parametrize(("seed", "height"), [(1, 8), (2, 2), (3, 3)])
def test_against_dictionaries(spark, seed, height):
    rows = rows_of(seed)
    assert got(spark, rows, settings=TrieSettings(height=height)) == plain(rows)


def test_a_long_conversation_and_a_large_group_of_copies(spark):
    rng = random.Random(9)
    rows = [(7, i, "user", rng.choice("ab")) for i in range(400)] + [(7, 500, "user", "same")] * 100
    rows += [(1000 + i, t, "user", f"copy {t}") for i in range(150) for t in range(3)]
    assert got(spark, rows, settings=TrieSettings(height=3)) == plain(rows)


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "a", "b")]) == []


def test_scan_goes_on_over_batches():
    rng = np.random.default_rng(3)
    conv = np.sort(rng.integers(0, 6, 400))
    x = [rng.integers(1, PRIME, 400).astype(np.uint64) for _ in BASES]
    scan, places, sums = Scan(), [], []
    for a, b in ((0, 1), (1, 150), (150, 151), (151, 400)):
        place, s = scan(conv[a:b], [y[a:b] for y in x])
        places += place.tolist()
        sums += list(zip(*[y.tolist() for y in s], strict=True))
    n = total = None
    for i, c in enumerate(conv):
        n, total = (n + 1, total) if i and conv[i - 1] == c else (1, (0, 0))
        total = tuple((t + int(y[i]) * pow(b, n, PRIME)) % PRIME for t, y, b in zip(total, x, BASES, strict=True))
        assert (places[i], sums[i]) == (n, total)
    a = rng.integers(0, PRIME, 300).astype(np.uint64)
    assert times(a, a[::-1]).tolist() == [int(p) * int(q) % PRIME for p, q in zip(a, a[::-1], strict=True)]


def test_a_conversation_is_spread_over_partitions(spark):
    df = spark.range(4000).selectExpr("5L AS conv_id", "0 AS turn", "'user' AS role", "'same' AS text")
    placed = placed_turns(df)
    assert placed.rdd.getNumPartitions() > 1
    assert sorted(r.place for r in placed.collect()) == list(range(1, 4001))
