"""Stored tables: layout, writing and reading."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import keys as K
from edgeloom.operators import ingest_assets as A
from edgeloom.operators import ingest_edges as G
from edgeloom.operators import ingest_files as FI
from edgeloom.operators.common import page
from edgeloom.schemas import schema, stored_schema

# Order of rows within the files of each table: row groups are then skipped by the names queries ask for.
SORT = {
    "assets": ["run_id", "short_name"],
    "asset_columns": ["run_id", "short_name"],
    "lineage": ["to_short", "run_id"],
    "asset_files": ["asset_id"],
    "files": ["run_id", "file_path"],
    "job_status": ["run_id", "last_updated"],
    "extraction_runs": ["run_id"],
    "run_facts": ["run_id"],
    "column_facts": ["run_id", "short_name"],
}


#: The stated columns of what is laid out under another name.
TABLE_OF = {"lineage": "edges"}

#: Where tables hold ids, these are digests written as text, which zstd halves and Spark's usual codec leaves as long as they are.
CODEC = "zstd"

#: Rows in a file of a hot run's directory, where no rebalance splits it.
ROWS_PER_FILE = 2_000_000

#: Ids that follow from other columns of their row. Tables may be stored without them: reading makes them.
IDS = {
    "assets": A.asset_ids, "asset_columns": A.column_ids, "column_facts": A.column_ids, "asset_files": A.link_ids, "files": FI.file_ids,
    "edges": G.edge_ids,
}

#: Order of rows without ids, where that with ids begins with one.
SORT_WITHOUT_IDS = {"asset_files": ["run_id", "short_name", "event_seq"]}


def _without(ids: Collection[str], df: DataFrame, name: str, usual: Sequence[str]) -> tuple[DataFrame, Sequence[str]]:
    """The rows without those ids, if any, and the order of what is stored."""
    order = SORT.get(name, usual)
    if not ids:
        return df, order
    held = [c for c in stored_schema(TABLE_OF.get(name, name)).names if c in df.columns and c not in ids]
    return df.select(*held), SORT_WITHOUT_IDS.get(name, order)


def write_table(
    df: DataFrame,
    path: str,
    name: str,
    extra_partitions: Sequence[str] = (),
    mode: str = "overwrite",
    ids: Collection[str] = (),
    by_run: bool = False,
) -> None:
    """Write a table in directories by run bucket. The rebalance before the write splits a bucket that one run
    fills, and joins small ones, so neither a hot run nor many runs make odd files. `ids` are those of `IDS` that are
    neither moved nor stored: the columns they follow from are, and of the others only the columns of the table. Rows that
    already lie together `by_run` are written where they lie, a task's share of a bucket in files of `ROWS_PER_FILE`."""
    partitions = [*extra_partitions, "run_bucket"]
    df, order = _without(ids, df, name, [])
    placed = df.withColumn("run_bucket", K.run_bucket("run_id"))
    placed = (placed if by_run else placed.hint("rebalance", *partitions)).sortWithinPartitions(*partitions, *order)
    if ids:
        placed = placed.withColumn("ids_follow", F.lit(True))
    writer = placed.write.mode(mode).option("compression", CODEC).option("maxRecordsPerFile", ROWS_PER_FILE if by_run else 0)
    writer.partitionBy(*partitions).parquet(path)


def write_together(df: DataFrame, path: str, table: str, parts: int, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Write rows so that those of one key lie in one of so many parts, and return them as stored. Each task sorts its own
    rows into the parts, packed by column, so none go through a shuffle; what is then grouped or joined by the key, or by it
    and more, is not shuffled either. `table` is the name by which the session knows the parts."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    df.write.mode("overwrite").option("compression", CODEC).bucketBy(parts, *by).option("path", path).saveAsTable(table)
    return spark.table(table)


def write_part(df: DataFrame, path: str, name: str, ids: Collection[str] = ()) -> None:
    """Write what one micro-batch adds to a table: a few files in the order of the table, the bucket as a column; `ids` as for
    `write_table`. Directories by run come with compaction."""
    df, order = _without(ids, df, name, ["run_id"])
    placed = df.withColumn("run_bucket", K.run_bucket("run_id")).hint("rebalance").sortWithinPartitions(*order)
    if ids:
        placed = placed.withColumn("ids_follow", F.lit(True))
    placed.write.mode("overwrite").option("compression", CODEC).parquet(path)


def at_once(*writes: Callable[[], None]) -> None:
    """Run writes that do not need each other as concurrent Spark jobs; the first failure is raised."""
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(inheritable_thread_target(w)) for w in writes]:
            done.result()


def write_logs(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Logs go in directories by day, so that retention drops whole directories."""
    placed = logs.hint("rebalance", "log_date").sortWithinPartitions("log_date", "run_id", "log_time")
    placed.write.mode(mode).partitionBy("log_date").parquet(path)


def read_table(spark: SparkSession, path: str, name: str, batches: bool = False) -> DataFrame:
    """A stored table, with its ids, also where rows are stored without them; `batches` for one written by a stream, in
    directories by batch."""
    held, stated = stored_schema(name), schema(name)
    if batches:
        held, stated = held.add("batch_id", "long"), stated.add("batch_id", "long")
    rows = spark.read.schema(held).parquet(path)
    if name not in IDS:
        return rows
    ids = {c: F.when(F.col("ids_follow"), e).otherwise(F.col(c)) for c, e in IDS[name]().items()}
    return rows.select(*[ids[c].alias(c) if c in ids else c for c in stated.names])


def kept(edges: DataFrame) -> DataFrame:
    """The lineage table: edges whose two ends are known."""
    return edges.filter(~F.col("skipped")).drop("skipped", "skip_reason")


def scan_page(df: DataFrame, order: Sequence[Column], page_no: int, size: int) -> DataFrame:
    """One page of a table in a total order."""
    return page(df, order, page_no, size)

