"""What the operators share: the given tables, tables written between steps, hashing rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.session import work_dir

#: Rows that a Python task is given at once, where rows hold whole texts: JVM and worker each hold one such batch.
TEXTS_AT_ONCE = 2_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared folder the session names."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and what was not deterministic is fixed."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_batches(df: DataFrame) -> DataFrame:
    """The rows; from now on the session hands them to Python at most `TEXTS_AT_ONCE` at a time."""
    conf = df.sparkSession.conf
    held = int(conf.get(ARROW_ROWS))
    if not 0 < held <= TEXTS_AT_ONCE:
        conf.set(ARROW_ROWS, str(TEXTS_AT_ONCE))
    return df


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, also where the name holds dots."""
    return df[f"`{name}`"]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def with_row_id(df: DataFrame) -> DataFrame:
    """A number per row that stays valid only once the result is stored."""
    return df.withColumn("row_id", F.monotonically_increasing_id())
