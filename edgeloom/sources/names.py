"""Copies of assets and edges by name, for questions that ask a few names over all runs.

The stored tables lie by run, so a question by name would read all of them. These copies lie in directories by a bucket of
the name in upper case, sorted by it, with a Parquet Bloom filter: a literal name reads one directory, and in it the row
groups that may hold the name. Edges are there twice, seen from either end, each end a copy of its own. The operators by
name take the copies in place of the tables. Ids and the neighbour's names follow from other columns: they are neither
moved nor stored, reading makes them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from edgeloom import constants as C
from edgeloom.functions import keys as K
from edgeloom.operators.catalog import assets_by_name
from edgeloom.operators.lineage import seen_from
from edgeloom.sources.tables import CODEC, IDS, at_once

SIDES = [C.UPSTREAM, C.DOWNSTREAM]


def _write(df: DataFrame, path: str, order: list[str], names: int) -> None:
    placed = df.withColumn("name_bucket", K.name_bucket("name_key")).hint("rebalance", "name_bucket")
    writer = placed.sortWithinPartitions("name_bucket", *order).write.mode("overwrite").option("compression", CODEC).partitionBy("name_bucket")
    for key, value in {"enabled": "true", "expected.ndv": str(names)}.items():
        writer = writer.option(f"parquet.bloom.filter.{key}#name_key", value)
    writer.parquet(path)


class ByName(Mapping[str, DataFrame]):
    """`assets` and `lineage` in the form by name, and the edges of one side alone, `upstream` or `downstream`. A copy is
    written when it is first asked for. `names_per_file` is the number of different names a file's Bloom filter is made for.
    A name with very many edges is split over files by the rebalance, as any large directory is."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], out: str, names_per_file: int = 100_000):
        self.spark, self.tables, self.out, self.names_per_file = spark, tables, out, names_per_file
        self.shapes: dict[str, StructType] = {}  # of the copies written

    def __iter__(self) -> Iterator[str]:
        return iter(["assets", "lineage", *SIDES])

    def __len__(self) -> int:
        return 2 + len(SIDES)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in [*self]:
            raise KeyError(name)
        parts = SIDES if name == "lineage" else [name]
        missing = {p: self._rows(p) for p in parts if p not in self.shapes}
        if missing:
            order = ["name_key", "created_at" if name == "assets" else "event_seq"]
            at_once(*[lambda p=p: _write(missing[p], self._path(p), order, self.names_per_file) for p in missing])
            self.shapes.update({p: df.schema for p, df in missing.items()})
        return self._read(*parts)

    def _path(self, part: str) -> str:
        return f"{self.out}/assets_by_name" if part == "assets" else f"{self.out}/edges_by_name/direction={part}"

    def _rows(self, part: str) -> DataFrame:
        if part == "assets":
            return assets_by_name(self.tables["assets"]).drop("run_bucket", *IDS["assets"]())
        return seen_from(self.tables["lineage"], part).drop("run_bucket", "direction", "neighbor", "neighbor_full", *IDS["edges"]())

    def _read(self, *parts: str) -> DataFrame:
        held = StructType([*self.shapes[parts[0]], StructField("name_bucket", IntegerType())])
        if parts == ("assets",):
            return self.spark.read.schema(held).parquet(self._path("assets")).withColumns(IDS["assets"]())
        reader = self.spark.read.schema(held.add("direction", "string")).option("basePath", f"{self.out}/edges_by_name")
        up = F.col("direction") == C.UPSTREAM
        neighbour = {f"neighbor{kind}": F.when(up, F.col(f"from{name}")).otherwise(F.col(f"to{name}")) for kind, name in (("", "_short"), ("_full", "_full"))}
        return reader.parquet(*map(self._path, parts)).withColumns(IDS["edges"]() | neighbour)
