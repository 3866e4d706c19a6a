"""Groups that stream by: rows arrive sorted by key, and each group is handed on whole.

For many small groups this costs far less than a function call of Spark per group. Groups are bounded by their maker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together and in order, ready for `streamed`."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def streamed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of `keys` (whole numbers), also where one spans several batches."""
    rest: pa.Table | None = None

    def cuts(table: pa.Table) -> np.ndarray:
        columns = [table[k].combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return np.flatnonzero(new) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            if len(at := cuts(pa.concat_tables([rest.slice(rest.num_rows - 1), table.slice(0, 1)]))):
                yield rest.combine_chunks()
            else:
                own = cuts(table)
                end = int(own[0]) if len(own) else table.num_rows
                rest = pa.concat_tables([rest, table.slice(0, end)])
                if end == table.num_rows:
                    continue
                yield rest.combine_chunks()
                table = table.slice(end)
        edges = [0, *cuts(table).tolist(), table.num_rows]
        for a, b in zip(edges[:-2], edges[1:-1], strict=True):
            yield table.slice(a, b - a)
        rest = table.slice(edges[-2])
    if rest is not None:
        yield rest.combine_chunks()


def tiles(block: Column, blocks: Column) -> Column:
    """The tiles of a block: every pair of blocks meets in one tile, numbered low * blocks + high."""
    others = F.sequence(F.lit(0), blocks - 1)
    return F.transform(others, lambda o: (F.least(block, o) * blocks + F.greatest(block, o)).cast("long"))


def tile_blocks(tile: int, blocks: int) -> tuple[int, int]:
    return divmod(tile, blocks)


class Forest:
    """Union-find over 0..n-1 that says which links join two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b
