"""Top-k and near-duplicate vectors against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm.embedding_dedup import CosineSettings, near_duplicate_vectors
from edgeloom.llm.topk import KnnSettings, top_k

NAN, INF = float("nan"), float("inf")


def random_vectors(n, dim, seed, clusters=6, noise=0.15):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim))
    return [(i, [float(np.float32(v)) for v in centres[r.integers(clusters)] + noise * r.normal(size=dim)], 0) for i in range(n)]


def odd_rows(dim):
    return [
        (9000, None, 0), (9001, [None] * dim, 0), (9002, [NAN] * dim, 0), (9100, [INF] * dim, 0), (9003, [0.0] * dim, 0), (9004, [1.0] * (dim - 1), 0),
        (9005, [], 0), *[(9200 + i, [0.5] * dim, 0) for i in range(30)], *[(9300, [0.25] * dim, 0)] * 2, (None, [0.5] * dim, 0),
    ]


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("settings", [KnnSettings(), KnnSettings(k=3, pivots=5, query_block=2, data_block=50), KnnSettings(k=40, pivots=300)])
def test_top_k(vectors, settings):
    dim = 5
    data = random_vectors(260, dim, 1) + odd_rows(dim)
    df = vectors(data).selectExpr("*", "1 AS q", "2 AS cell", "3 AS `at`")
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 100 == 0, settings=settings).collect()))
    use = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in data if i is not None and fine(v) and len(v) == dim]
    want = []
    for i in sorted({i for i, _ in use if i % 100 == 0}):
        for q in [v for j, v in use if j == i]:
            scored = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in use if j != i))[: settings.k]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    # Repeated rows of one query have one list.
    assert got == sorted(set(want))


def test_top_k_without_queries_or_rows(vectors):
    assert top_k(vectors([]), F.col("vec_id") % 100 == 0).collect() == []
    assert top_k(vectors([(1, [1.0], 0)]), F.col("vec_id") % 100 == 0).collect() == []
    assert top_k(vectors([(100, [1.0], 0)]), F.col("vec_id") % 100 == 0).collect() == []


def brute_links(data, threshold):
    use = [(i, np.array(v, dtype=float)) for i, v, _ in data if i is not None and fine(v) and any(v)]
    links = {i: 0 for i, _, _ in data if i is not None}
    parent = {i: i for i in links}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(use):
        for j, y in use[a + 1 :]:
            if len(x) == len(y) and i != j and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (n, root(i)) for i, n in links.items()}


@pytest.mark.parametrize(("settings", "dim"), [(CosineSettings(), 6), (CosineSettings(block=20, step=2, axes=3), 8), (CosineSettings(threshold=0.97, step=100), 2), (CosineSettings(), 1)])
def test_near_duplicates(vectors, settings, dim):
    data = random_vectors(200, dim, dim, clusters=30) + [r for r in odd_rows(dim) if r[0] not in (9300, None)]
    random.Random(1).shuffle(data)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(vectors(data).selectExpr("*", "1 AS rep", "2 AS c0"), settings).collect()}
    assert got == brute_links(data, settings.threshold)


def test_near_duplicates_keep_every_row(vectors):
    rows = near_duplicate_vectors(vectors([(None, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (4, [1.0, 1e-9], 0), (6, [-0.0, 1.0], 0), (7, [0.0, 1.0], 0)])).collect()
    said = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert said == {None: (0, None, None), 5: (1, 4, False), 4: (1, 4, True), 6: (1, 6, True), 7: (1, 6, False)}
    assert near_duplicate_vectors(vectors([])).collect() == []
    assert near_duplicate_vectors(vectors([(3, None, 0)])).collect()[0].n_links == 0


def test_top_k_of_a_query_id_on_many_rows(vectors):
    """Rows with the query's own id take no part in the answer, so they must not tighten what is searched, whatever their cell."""
    near = [(100, [10.0, 0.0], 0)] * 10 + [(100, [10.0 + 0.001 * i, 0.0], 0) for i in range(1, 11)]
    data = near + [(i, [9.0 * math.cos(i), 9.0 * math.sin(i)], 0) for i in range(1, 61)]
    settings = KnnSettings(k=5, pivots=200)
    got = sorted(map(tuple, top_k(vectors(data), F.col("vec_id") == 100, settings=settings).collect()))
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in data]
    asks = min(v for i, v in whole if i == 100)
    scored = sorted((-sum(a * b for a, b in zip(asks, v)), i) for i, v in whole if i != 100)[:5]
    assert got == [(100, r + 1, i, -s) for r, (s, i) in enumerate(scored)]


@pytest.mark.parametrize("size", [3e6, 4e9, 1e15])
def test_top_k_of_large_values_is_exact(vectors, size):
    r = np.random.default_rng(7)
    data = [(i, [float(v) for v in size * r.normal(size=3)], 0) for i in range(80)] + [(500 + i, [1e300, 1.0, 1.0], 0) for i in range(2)]
    got = sorted(map(tuple, top_k(vectors(data, "double"), F.col("vec_id") % 10 == 0).collect()))
    use = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in data if i < 500]
    want = []
    for i, q in use:
        if i % 10 == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(q, v)), -(2**63) + 1), 2**63 - 1), j) for j, v in use if j != i)[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    assert got == sorted(want)


def test_top_k_searches_each_length(vectors):
    data = [(100 * n + i, [float(i + 1)] * n, 0) for n in (1, 2, 3) for i in range(4)]
    got = sorted(map(tuple, top_k(vectors(data), F.col("vec_id") % 100 == 0).collect()))
    want = [(100 * n, k + 1, 100 * n + i, n * 1024 * 1024 * (i + 1)) for n in (1, 2, 3) for k, i in enumerate((3, 2, 1))]
    assert got == want


def test_near_duplicates_meet_in_ids_of_several_vectors(vectors):
    """Rows of an id are one node whichever vectors they hold; each row counts what its own vector is linked with."""
    b, c, d = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    data = [(7, b, 0), (8, b, 0), (8, c, 0), (9, c, 0), (7, d, 0), (9, None, 0), (20, d, 0), (30, [-1.0, 0.0, 0.0], 0), (31, None, 0)]
    rows = near_duplicate_vectors(vectors(data)).collect()
    assert {r.vec_id: r.component_id for r in rows} == {7: 7, 8: 7, 9: 7, 20: 7, 30: 30, 31: 31}
    assert sorted((r.vec_id, r.n_links) for r in rows) == [(7, 1), (7, 1), (8, 1), (8, 1), (9, 0), (9, 1), (20, 1), (30, 0), (31, 0)]
    assert len({(r.vec_id, r.component_id) for r in rows}) == len({r.vec_id for r in rows})
