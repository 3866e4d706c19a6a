"""Container output lines as log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import constants as C
from edgeloom.functions import keys as K
from edgeloom.sources.placed_lines import PlacedLines


def log_level() -> Column:
    """ERROR for a non-zero exit and for a launch error, else INFO."""
    code = F.regexp_extract("message", C.EXIT_LINE, 1)
    failed = (code != "") & (code != "0")
    return F.when(failed | F.col("message").rlike(C.LAUNCH_ERROR_LINE), "ERROR").otherwise("INFO")


def log_rows(lines: DataFrame) -> DataFrame:
    """`run_id, message, log_time` to log rows. The id is taken from the content: a raw line has no number."""
    return lines.select(
        K.stable_id("run_id", "log_time", "message").alias("log_id"),
        "run_id",
        log_level().alias("log_level"),
        "message",
        "log_time",
        F.lit(C.LOG_SOURCE).alias("source"),
        F.col("log_time").cast("date").alias("log_date"),
    )


def _with_run(lines: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return lines.select(
        F.regexp_extract(path, r"([^/]+?)(\.[^/.]*)?$", 1).alias("run_id"),
        F.col("value").alias("message"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("log_time"),
    )


def read_container_logs(spark: SparkSession, path: str) -> DataFrame:
    """Files named by run id, one output line per line. The time is that of the file."""
    return log_rows(_with_run(spark.read.text(path)))


def stream_container_logs(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger).load(path)
    return log_rows(_with_run(lines))


def placed_log_rows(lines: DataFrame) -> DataFrame:
    """Log rows of lines that know their place, with `file` and `at`: equal lines have ids of their own, and the lines of a run are in
    order by time, file and place. The run is named by the folder `run_id=..` or by the file."""
    path = F.col("file")
    folder = F.regexp_extract(path, r"run_id=([^/]+)/", 1)
    rows = lines.select(
        F.when(folder != "", folder).otherwise(F.regexp_extract(path, r"([^/]+?)(\.[^/.]*)?$", 1)).alias("run_id"),
        F.col("line").alias("message"),
        F.col("written_at").alias("log_time"),
        "file",
        "at",
    )
    return rows.select(
        K.stable_id("run_id", "file", "at").alias("log_id"),
        "run_id",
        log_level().alias("log_level"),
        "message",
        "log_time",
        F.lit(C.LOG_SOURCE).alias("source"),
        F.col("log_time").cast("date").alias("log_date"),
        "file",
        "at",
    )


def read_log_files(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """Log files as rows, each line with its place."""
    spark.dataSource.register(PlacedLines)
    return placed_log_rows(spark.read.format(PlacedLines.name()).option("range_bytes", range_bytes).load(path))


def follow_log_files(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """The same as a stream that goes on with lines appended to files already read."""
    spark.dataSource.register(PlacedLines)
    return placed_log_rows(spark.readStream.format(PlacedLines.name()).option("range_bytes", range_bytes).load(path))
