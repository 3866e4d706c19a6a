"""Live log tail: log lines after a time, appended as they land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tail(logs: DataFrame, since: Column | None = None) -> DataFrame:
    """Streaming or not, the lines strictly after `since`. There is no state to keep."""
    return logs if since is None else logs.filter(F.col("log_time") > since)


def start_tail(
    logs: DataFrame, out: str, checkpoint: str, since: Column | None = None, available_now: bool = True
) -> StreamingQuery:
    """Append the tail of a log stream to a table by day."""
    rows = tail(logs, since)
    if "log_date" not in rows.columns:
        rows = rows.withColumn("log_date", F.col("log_time").cast("date"))
    writer = rows.writeStream.format("parquet").outputMode("append").partitionBy("log_date")
    writer = writer.option("checkpointLocation", checkpoint).option("path", out)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()
