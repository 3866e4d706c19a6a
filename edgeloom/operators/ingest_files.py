"""File records of file events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as C
from edgeloom.functions import keys as K
from edgeloom.functions import text as T
from edgeloom.sources.events import route


def file_records(decoded: DataFrame) -> DataFrame:
    """One row per file event. A blank hash becomes the default; type and status match exactly or fall back."""
    return file_parts(decoded).select(*[e.alias(c) for c, e in file_ids().items()], "*")


def file_ids() -> dict[str, Column]:
    return {"file_id": K.stable_id(*C.EVENT_KEY)}


def file_parts(decoded: DataFrame) -> DataFrame:
    """The same rows without their ids."""
    given_hash = F.col("file.fileHash")
    return route(decoded, C.FILE_EXTRACTION).select(
        *C.EVENT_KEY,
        F.col("file.filePath").alias("file_path"),
        T.file_type(F.col("file.fileType")).alias("file_type"),
        F.col("file.fileUrl").alias("file_url"),
        F.when(T.is_blank(given_hash), C.UNKNOWN_HASH).otherwise(given_hash).alias("file_hash"),
        F.col("event_time").alias("extracted_at"),
        T.file_status(F.col("file.status")).alias("status"),
        F.col("event_time").alias("created_at"),
    )
