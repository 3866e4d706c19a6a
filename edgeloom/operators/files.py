"""Questions on file records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as C
from edgeloom.operators.common import Ids, pick


def files_of_run(files: DataFrame, ids: Ids = None) -> DataFrame:
    return pick(files, "run_id", ids).orderBy("run_id", "file_path", "file_id")


def files_by_hash(files: DataFrame, file_hash: str) -> DataFrame:
    return files.filter(F.col("file_hash") == file_hash)


def files_sharing_hash(files: DataFrame) -> DataFrame:
    """Files whose content occurs more than once, with the number of copies. The counts are combined before the
    shuffle and only repeated hashes go into the join, where a hot hash is split like any hot join key."""
    repeated = files.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")
    return files.join(repeated, "file_hash")


def file_by_path(files: DataFrame, ids: Ids = None, file_path: str | None = None) -> DataFrame:
    """One file per run and path; a key with more rows has no answer and is in `ambiguous_paths`."""
    picked = pick(files, "run_id", ids)
    if file_path is not None:
        picked = picked.filter(F.col("file_path") == file_path)
    row = F.struct(*[F.col(c) for c in files.columns])
    return (
        picked.groupBy("run_id", "file_path")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.any_value(row).alias("row"))
        .filter("n_rows = 1")
        .select("row.*")
    )


def ambiguous_paths(files: DataFrame) -> DataFrame:
    return files.groupBy("run_id", "file_path").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def files_by_status(files: DataFrame, status: str, ids: Ids = None) -> DataFrame:
    return pick(files, "run_id", ids).filter(F.col("status") == status)


def count_by_run(files: DataFrame, ids: Ids = None) -> DataFrame:
    return pick(files, "run_id", ids).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_files"))


def count_by_run_and_status(files: DataFrame, ids: Ids = None) -> DataFrame:
    status = F.col("status")
    return (
        pick(files, "run_id", ids)
        .groupBy("run_id")
        .agg(
            F.count_if(status == C.SUCCESS).alias("n_success"),
            F.count_if(status == C.FAILED).alias("n_failed"),
            F.count_if(status == C.SKIPPED).alias("n_skipped"),
        )
    )


def files_by_type(files: DataFrame, file_type: str | None = None) -> DataFrame:
    picked = files if file_type is None else files.filter(F.col("file_type") == file_type)
    return picked.orderBy("file_type", F.desc("created_at"), "file_id")
