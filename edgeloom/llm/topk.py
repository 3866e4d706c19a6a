"""Exact top-k by inner product as a Voronoi kNN join.

Vectors become whole numbers, floor(1024 x). An inner product turns into a distance by one more coordinate: with M the
largest squared length of a vector, x gets sqrt(M - |x|^2) and q gets 0, and then |q - x|^2 = |q|^2 + M - 2 q.x, so the
largest products are the nearest neighbours.

Pivots, a bounded seeded choice of vectors, part queries and data into Voronoi cells. Per cell there is a summary: for
queries the radius, for data the k + 1 smallest distances to the pivot of different ids. From them follows, per query cell, a bound on the
distance of the k-th neighbour of any of its queries. Query cells near each other make groups of bounded size, large
ones are split; a data vector is copied to a group only if the triangle inequality lets it lie within the bound of one
of its cells. Tasks then solve a group of queries against a block of data by exact integer products - in doubles where no sum
can pass 2**53, else in whole numbers - and the k best of each block meet in a final ranking.

Defined results: vectors that are null or empty or hold null or non-finite components take no part, nor do those with a
component that has no whole number of 64 bits at this scale; vectors of each length are searched by themselves, for only
those have products; a score beyond 64 bits is given as the largest or smallest such number; ties go to the smaller
vec_id, repeated rows are candidates each (rows with a query's own vec_id are left out), and of query rows with one vec_id
and length the one with the smallest vector asks; with fewer than k candidates all are given; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import column, stored
from edgeloom.llm.groups import dealt_by, streamed

SCALE = 1024


@dataclass(frozen=True)
class KnnSettings:
    """`pivots`: cells. `query_block`, `data_block`: what a task multiplies at once."""

    k: int = 10
    pivots: int = 64
    query_block: int = 512
    data_block: int = 4096
    slack: float = 1e-6
    seed: int = 23


def usable(vector: Column) -> Column:
    """True for vectors of finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def quantized(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, q (whole numbers), norm2 (as a double) of the usable vectors."""
    v = column(vectors, vector)
    scaled = F.transform(v, lambda x: F.lit(float(SCALE)) * x.cast("double"))
    fits = F.forall(scaled, lambda x: F.abs(x) < F.lit(2.0**63))
    whole = F.when(usable(v) & fits, F.transform(scaled, lambda x: F.floor(x)))
    rows = vectors.select(column(vectors, key).cast("long").alias("vec_id"), whole.alias("q"))
    rows = rows.filter(F.col("q").isNotNull() & F.col("vec_id").isNotNull())
    return rows.withColumn("norm2", F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _whole(group: pa.Table, name: str) -> np.ndarray:
    values = group[name].combine_chunks()
    return values.flatten().to_numpy().reshape(len(values), -1)


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact, held in 64 bits."""
    most = max((float(np.abs(m.astype(np.float64)).max()) if m.size else 0.0) for m in (x, y))
    if x.shape[1] * most * most < 2.0**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if x.shape[1] * most * most < 2.0**63:
        return x @ y.T
    exact = x.astype(object) @ y.astype(object).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _matrix(batch, name: str) -> np.ndarray:
    values = batch.column(name) if isinstance(batch, pa.RecordBatch) else batch[name].combine_chunks()
    return values.flatten().to_numpy().reshape(len(values), -1).astype(np.float64)


def to_cells(rows: DataFrame, pivots: np.ndarray, top: float, is_query: Column) -> DataFrame:
    """Each vector with its cell and distance, once as data and, if it is a query, once more as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (pivots**2).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ask = _matrix(batch, "q"), batch.column("is_query").to_numpy(zero_copy_only=False)
            norm2 = batch.column("norm2").to_numpy().astype(np.float64)
            for query in (False, True):
                own = np.flatnonzero(ask) if query else np.arange(len(x))
                last = np.zeros(len(own)) if query else np.sqrt(np.maximum(top - norm2[own], 0))
                full = np.column_stack([x[own], last])
                apart = np.maximum((full**2).sum(axis=1)[:, None] + lengths - 2 * full @ pivots.T, 0)
                cell = apart.argmin(axis=1) if len(own) else np.empty(0, dtype=np.int64)
                far = np.sqrt(apart[np.arange(len(own)), cell])
                took = batch.take(pa.array(own))
                arrays = [took.column(c) for c in ("at", "vec_id", "q")]
                arrays += [pa.array(np.full(len(own), query)), pa.array(cell.astype(np.int32)), pa.array(far)]
                yield pa.record_batch(arrays, names=["at", "vec_id", "q", "query", "cell", "far"])

    marked = rows.select(F.monotonically_increasing_id().alias("at"), "vec_id", "q", "norm2", is_query.alias("is_query"))
    return marked.mapInArrow(run, "at long, vec_id long, q array<long>, query boolean, cell int, far double")


def reach(placed: DataFrame, pivots: np.ndarray, settings: KnnSettings) -> np.ndarray:
    """least[i, j]: data of cell j nearer to its pivot than this are out of reach for all queries of cell i.

    Everything here is of the size of the pivots: radii, and the k + 1 smallest distances of different ids per data cell.
    """
    n, k = len(pivots), settings.k
    scale = float(np.sqrt((pivots**2).sum(axis=1)).max())  # distances are as exact as the lengths they come from
    radius = np.full(n, -1.0)
    for r in placed.filter("query").groupBy("cell").agg(F.max("far").alias("r")).collect():
        radius[r.cell] = r.r
    nearest = Window.partitionBy("cell").orderBy("far")
    # One more than k, and each id once per cell: rows with a query's own id take no part in its answer.
    ids = placed.filter("not query").groupBy("cell", "vec_id").agg(F.min("far").alias("far"))
    close = ids.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k + 1)
    held = close.select("cell", "vec_id", "far").collect()
    cell, own, far = (np.array([r[c] for r in held], dtype=t) for c, t in (("cell", np.int64), ("vec_id", np.int64), ("far", np.float64)))
    between = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2), 0))
    least = np.full((n, n), np.inf)
    for i in np.flatnonzero(radius >= 0):
        bounds = radius[i] + between[i][cell] + far
        order = np.argsort(bounds)
        first = np.sort(np.unique(own[order], return_index=True)[1])  # where each id is nearest, over all cells
        # The (k + 1)-th id: at least k ids other than the query's are within it.
        limit = bounds[order[first[k]]] if len(first) > k else np.inf
        # |q, x| >= |p_i, p_j| - radius_i - |p_j, x|
        least[i] = between[i] - radius[i] - limit * (1 + settings.slack) - settings.slack * (1 + scale)
    return least


@dataclass(frozen=True)
class Unit:
    """Query cells solved together, as group `first`; a single large cell is dealt over `parts` groups from `first`."""

    cells: tuple[int, ...]
    first: int
    parts: int


def query_groups(counts: dict[int, int], pivots: np.ndarray, size: int) -> list[Unit]:
    """Neighbouring cells together up to `size` queries; larger cells alone, in parts."""
    left, units, first = set(counts), [], 0
    while left:
        cell = min(left)
        own = [cell]
        left.remove(cell)
        if counts[cell] <= size:
            near = sorted(left, key=lambda c: (((pivots[c] - pivots[cell]) ** 2).sum(), c))
            total = counts[cell]
            for c in near:
                if total + counts[c] <= size:
                    own.append(c)
                    total += counts[c]
            left.difference_update(own)
        units.append(Unit(tuple(own), first, -(-counts[cell] // size)))
        first += units[-1].parts
    return units


def top_k(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", settings: KnnSettings = KnnSettings()
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query. `is_query` is on vec_id."""
    rows = quantized(vectors, key, vector)
    lengths = rows.groupBy(F.size("q").alias("n")).agg(F.count(F.lit(1)).alias("total"), F.count_if(is_query).alias("queries"), F.max("norm2").alias("top"))
    found = None
    for r in lengths.filter("queries > 0").orderBy("n").collect():  # one row per length in use
        best = _search(rows.filter(F.size("q") == r.n), is_query, r.total, r.top, settings)
        found = best if found is None else found.union(best)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", ranked).filter(F.col("rank") <= settings.k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, is_query: Column, total: int, top: float, settings: KnnSettings) -> DataFrame:
    """query_id, vec_id, score: the best of each query in each block, for vectors of one length."""
    spark = rows.sparkSession
    chosen = rows.select("q", "norm2", F.xxhash64(F.lit(settings.seed), "vec_id").alias("at")).orderBy("at").limit(settings.pivots).collect()
    pivots = np.array([[*r.q, np.sqrt(top - r.norm2)] for r in chosen], dtype=np.float64)
    placed = stored(to_cells(rows, pivots, float(top), is_query), "cells")
    least = reach(placed, pivots, settings)

    counts = {r.cell: r.n for r in placed.filter("query").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    units = query_groups(counts, pivots, settings.query_block)
    blocks = max(1, -(-total // settings.data_block))
    cells = range(len(pivots))
    unit_of = {cell: unit for unit in units for cell in unit.cells}

    def by_cell(value) -> Column:
        return F.element_at(F.array(*[F.lit(value(unit_of[c]) if c in unit_of else 1) for c in cells]), F.col("cell") + 1)

    slot = by_cell(lambda u: u.first) + F.pmod(F.xxhash64("at"), by_cell(lambda u: u.parts))
    one = placed.filter("query").groupBy("vec_id").agg(F.min(F.struct("q", "cell", "at")).alias("x"))
    asked = one.select("vec_id", "x.*", F.lit(True).alias("query")).withColumn("grp", slot.cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    plan = spark.createDataFrame(
        [(j, [(float(min(least[i, j] for i in u.cells)), u.first, u.parts) for u in units]) for j in cells],
        "cell int, who array<struct<at: double, first: int, parts: int>>",
    )
    needed = F.filter("who", lambda w: w["at"] <= F.col("far"))
    numbers = F.flatten(F.transform(needed, lambda w: F.sequence(w["first"], w["first"] + w["parts"] - 1)))
    # The plan has a row per pivot.
    offered = placed.filter("not query").join(F.broadcast(plan), "cell").withColumn("grp", F.explode(numbers))
    offered = offered.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int"))
    columns = ["grp", "block", "query", "vec_id", "q"]
    met = dealt_by(asked.select(*columns).union(offered.select(*columns)), "grp", "block")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in streamed(batches, ["grp", "block"]):
            ask = group["query"].to_numpy()
            if ask.all() or not ask.any():
                continue
            ids, x = group["vec_id"].to_numpy(), _whole(group, "q")
            query_ids, data_ids = ids[ask], ids[~ask]
            products = exact_products(x[ask], x[~ask])
            own = query_ids[:, None] == data_ids[None, :]
            products[own] = np.iinfo(np.int64).min
            k = min(settings.k, len(data_ids))
            last = np.partition(products, len(data_ids) - k, axis=1)[:, len(data_ids) - k]
            who, what = np.nonzero((products >= last[:, None]) & ~own)
            score = products[who, what]
            order = np.lexsort((data_ids[what], ~score, who))
            who, what, score = who[order], what[order], score[order]
            starts = np.searchsorted(who, who, side="left")
            fine = np.arange(len(who)) - starts < k
            who, what, score = who[fine], what[fine], score[fine]
            arrays = [pa.array(query_ids[who]), pa.array(data_ids[what]), pa.array(score)]
            yield pa.record_batch(arrays, names=["query_id", "vec_id", "score"])

    return met.mapInArrow(solve, "query_id long, vec_id long, score long")
