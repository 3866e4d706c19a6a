"""Near-duplicate vectors by a PCA-ordered tiled comparison.

Vectors are scaled to length one, equal ones are taken together, and all are turned into the order of their principal
axes (from second moments over all vectors), so leading coordinates hold most of a product. Tiles of bounded blocks
compare every pair of blocks that can hold a link: the products of leading coordinates are added up first, the rest is
bounded by the product of the norms of what is left, and a pair is given up once its cosine cannot reach the threshold.

Blocks come from cells of the first principal axes. With lengths of one a cosine of c means a distance of
sqrt(2 - 2c), so linked vectors lie in the same or neighbouring cells of that width; other pairs of cells never meet.

Each tile gives link counts per vector and the links of a spanning forest, never all pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components have no links and are their
own component; vectors of different lengths are not linked; rows of one vec_id are one node, and each
counts the other rows that its own vector is linked with; equal vectors are linked with each other; a null vec_id is linked with nothing; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import column, stored
from edgeloom.llm.components import components
from edgeloom.llm.groups import Forest, dealt_by, streamed
from edgeloom.llm.topk import usable


@dataclass(frozen=True)
class CosineSettings:
    """`axes`: principal axes that make cells. `block`: vectors of a block. `step`: coordinates added at once."""

    threshold: float = 0.9
    axes: int = 2
    block: int = 2048
    step: int = 16
    slack: float = 1e-9


def second_moments(vectors: DataFrame, size: int) -> np.ndarray:
    """Sum of x x^T over all vectors: a matrix per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = unit(_rows(batch.column(0)))
                total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["at", "value"])

    summed = vectors.select("vec").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(size * size)
    table = summed.toArrow()  # size x size numbers
    out[table["at"].to_numpy()] = table["value"].to_numpy()
    return out.reshape(size, size)


def _rows(values) -> np.ndarray:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy().reshape(len(values), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def placed_in_cells(vectors: DataFrame, axes: np.ndarray, width: float) -> DataFrame:
    """rep, copies, vec, c0, c1, ..: the cell from the first principal axes, a number per axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.floor(unit(_rows(batch.column("vec"))) @ axes / width).astype(np.int32)
                cells = [pa.array(np.ascontiguousarray(at[:, i])) for i in range(axes.shape[1])]
                yield pa.record_batch([*batch.columns, *cells], names=[*batch.schema.names, *[f"c{i}" for i in range(axes.shape[1])]])

    schema = f"rep long, copies long, vec {vectors.schema['vec'].dataType.simpleString()}, " + ", ".join(f"c{i} int" for i in range(axes.shape[1]))
    return vectors.select("rep", "copies", "vec").mapInArrow(run, schema)


def _plain(vector: Column) -> Column:
    """The vector with -0 as 0, so equal vectors are equal keys."""
    return F.transform(vector, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))


def tiles_of(cells: DataFrame, settings: CosineSettings) -> DataFrame:
    """Copies of each vector for every tile it takes part in: (tile of two blocks, side).

    Blocks of a cell meet each other and the blocks of the cells after it that touch it.
    """
    names = [f"c{i}" for i in range(settings.axes)]
    sizes = cells.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.select(*names, F.ceil(F.col("n") / settings.block).cast("int").alias("blocks"))
    steps = [()]
    for _ in names:
        steps = [(*s, d) for s in steps for d in (-1, 0, 1)]
    after = [s for s in steps if s > (0,) * len(names)]
    # Per pair of touching cells: the blocks of both. `dir` 0 is a cell with itself.
    shift = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("dir"), *[F.lit(d).alias(n) for d, n in zip(s, names, strict=True)]) for i, s in enumerate(after)]))
    moved = blocks.select(*names, F.col("blocks").alias("low_blocks"), shift.alias("s")).select(
        *[F.col(n).alias(f"low_{n}") for n in names], "low_blocks", "s.dir", *[(F.col(n) + F.col(f"s.{n}")).alias(n) for n in names]
    )
    touching = moved.join(blocks.withColumnRenamed("blocks", "high_blocks"), names)
    low = touching.select(*[F.col(f"low_{n}").alias(n) for n in names], "dir", F.lit(False).alias("high"), *[f"low_{n}" for n in names], "low_blocks", "high_blocks")
    high = touching.select(*names, "dir", F.lit(True).alias("high"), *[f"low_{n}" for n in names], "low_blocks", "high_blocks")
    own = blocks.select(*names, F.lit(0).alias("dir"), F.lit(False).alias("high"), *[F.col(n).alias(f"low_{n}") for n in names], F.col("blocks").alias("low_blocks"), F.col("blocks").alias("high_blocks"))
    meetings = low.union(high).union(own)

    joined = cells.join(meetings, names)
    mine = F.when(F.col("high"), F.col("high_blocks")).otherwise(F.col("low_blocks"))
    joined = joined.withColumn("block", F.pmod(F.xxhash64("rep"), mine).cast("int"))
    across = F.transform(
        F.sequence(F.lit(0), F.when(F.col("high"), F.col("low_blocks")).otherwise(F.col("high_blocks")) - 1),
        lambda o: F.struct(
            F.when(F.col("high"), o).otherwise(F.col("block")).alias("i"), F.when(F.col("high"), F.col("block")).otherwise(o).alias("j"), F.col("high").alias("right")
        ),
    )
    inside = F.transform(
        F.sequence(F.lit(0), F.col("low_blocks") - 1),
        lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j"), (F.col("block") > o).alias("right")),
    )
    spread = joined.withColumn("t", F.explode(F.when(F.col("dir") == 0, inside).otherwise(across)))
    tile = F.xxhash64(*[f"low_{n}" for n in names], "dir", "t.i", "t.j")
    same = (F.col("dir") == 0) & (F.col("t.i") == F.col("t.j"))
    return spread.select(tile.alias("tile"), F.col("t.right").alias("right"), same.alias("same"), "rep", "copies", "vec")


def tile_links(x: np.ndarray, y: np.ndarray, settings: CosineSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) whose product of principal coordinates may reach the threshold, with that product.

    Coordinates are added `step` at a time; what is left is bounded by the product of the norms of the rest.
    """
    rest_x = np.sqrt(np.maximum(np.cumsum((x**2)[:, ::-1], axis=1)[:, ::-1], 0))
    rest_y = np.sqrt(np.maximum(np.cumsum((y**2)[:, ::-1], axis=1)[:, ::-1], 0))
    size, floor = x.shape[1], settings.threshold - settings.slack
    done = min(settings.step, size)
    part = x[:, :done] @ y[:, :done].T
    bound = part + rest_x[:, done][:, None] * rest_y[:, done][None, :] if done < size else part
    i, j = np.nonzero(bound >= floor)
    total = part[i, j]
    while done < size and len(i):
        to = min(done + settings.step, size)
        total = total + (x[i, done:to] * y[j, done:to]).sum(axis=1)
        done = to
        reach = total + rest_x[i, done] * rest_y[j, done] if done < size else total
        fine = reach >= floor
        i, j, total = i[fine], j[fine], total[fine]
    return i, j, total


def compared(tiles: DataFrame, axes: np.ndarray, settings: CosineSettings) -> DataFrame:
    """Per tile: a, b (a link of the forest, or b null) and count (linked vectors of a, copies included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in streamed(batches, ["tile"]):
            right, same = group["right"].to_numpy(), group["same"][0].as_py()
            if group.num_rows < 2 or not same and (right.all() or not right.any()):
                continue
            reps, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
            plain = _rows(group["vec"])
            turned = unit(plain) @ axes
            left = np.arange(len(reps)) if same else np.flatnonzero(~right)
            other = left if same else np.flatnonzero(right)
            i, j, _ = tile_links(turned[left], turned[other], settings)
            i, j = left[i], other[j]
            if same:
                i, j = i[i < j], j[i < j]
            # The cosine itself, as defined, decides.
            lengths = np.sqrt((plain**2).sum(axis=1))
            cosine = (plain[i] * plain[j]).sum(axis=1) / (lengths[i] * lengths[j])
            odd = ~np.isfinite(cosine)
            if odd.any():
                scaled = unit(plain)
                cosine[odd] = (scaled[i[odd]] * scaled[j[odd]]).sum(axis=1)
            i, j = i[cosine >= settings.threshold], j[cosine >= settings.threshold]
            if not len(i):
                continue
            counts = np.bincount(i, copies[j], len(reps)) + np.bincount(j, copies[i], len(reps))
            forest = Forest(len(reps))
            tree = [(int(a), int(b)) for a, b in zip(i, j, strict=True) if forest.join(int(a), int(b))]
            some = np.flatnonzero(counts)
            a = np.concatenate([reps[some], reps[[t[0] for t in tree]]])
            b = pa.array([None] * len(some) + reps[[t[1] for t in tree]].tolist(), pa.int64())
            n = np.concatenate([counts[some].astype(np.int64), np.zeros(len(tree), dtype=np.int64)])
            yield pa.record_batch([pa.array(a), b, pa.array(n)], names=["a", "b", "count"])

    return dealt_by(tiles, "tile").mapInArrow(run, "a long, b long, count long")


def near_duplicate_vectors(vectors: DataFrame, settings: CosineSettings = CosineSettings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    v = column(vectors, vector)
    nonzero = F.exists(v, lambda x: x != 0)
    every = vectors.select(column(vectors, key).cast("long").alias("vec_id"), F.when(usable(v) & nonzero, _plain(v)).alias("vec"))
    usable_rows = every.filter(F.col("vec").isNotNull() & F.col("vec_id").isNotNull())
    classes = usable_rows.groupBy("vec").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    # A class of equal vectors has a number of its own: an id may be the least of several classes.
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")

    found = []
    sizes = [r.n for r in classes.select(F.size("vec").alias("n")).distinct().orderBy("n").collect()]  # lengths in use
    for size in sizes:
        own = classes.filter(F.size("vec") == size)
        axes = np.linalg.eigh(second_moments(own, size))[1][:, ::-1]  # columns, the widest first
        width = np.sqrt(2 - 2 * settings.threshold) * (1 + 1e-6)
        cells = placed_in_cells(own, np.ascontiguousarray(axes[:, : settings.axes]), width)
        if size < settings.axes:
            for i in range(size, settings.axes):
                cells = cells.withColumn(f"c{i}", F.lit(0))
        cells = stored(cells, "vector-cells")
        found.append(compared(tiles_of(cells, settings), axes, settings))
    result = every
    if not found:
        return result.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    links = stored(links, "vector-links")
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("count").alias("others"))
    # Rows of one id with different vectors are one node: their classes meet in it.
    member = stored(every.join(classes.select("vec", "rep"), "vec", "left").select("vec_id", "rep"), "vector-members")
    met = member.filter(F.col("rep").isNotNull()).groupBy("vec_id", "rep").agg(F.count(F.lit(1)).alias("n"))
    several = met.groupBy("vec_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).filter("b < most").drop("most")
    by_id = met.join(several, "vec_id").select(F.col("rep").alias("a"), "b")
    joined = components(links.filter("b is not null").select("a", "b").union(by_id)).withColumnRenamed("node", "rep")
    grouped = classes.select("rep", "least_id", "copies").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    grouped = stored(grouped, "vector-components")
    least = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = grouped.join(least, "component").join(counts, "rep", "left")
    named = named.select("rep", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    # Also a row whose vector takes no part is of the node of its id, where the id has others.
    lone = member.filter(F.col("rep").isNull()).select("vec_id").distinct()
    part = met.join(lone, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("rep").alias("id_rep"))
    part = part.join(named.select(F.col("rep").alias("id_rep"), F.col("component_id").alias("part_id")), "id_rep").drop("id_rep")
    return (
        member.join(named, "rep", "left")
        .join(part, "vec_id", "left")
        .select(
            "vec_id",
            F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
            F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "part_id", "vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
