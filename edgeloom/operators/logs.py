"""Questions on extraction logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as C
from edgeloom.operators.common import Ids, pick, top_k

_NEWEST = ("log_time", "log_id")


def logs_oldest_first(logs: DataFrame, ids: Ids = None) -> DataFrame:
    return pick(logs, "run_id", ids).orderBy("run_id", *_NEWEST)


def recent_logs(logs: DataFrame, n: int, ids: Ids = None) -> DataFrame:
    """The last `n` lines of each run, `rn` = 1 being the newest."""
    return top_k(pick(logs, "run_id", ids), ["run_id"], [F.desc(c) for c in _NEWEST], n, salt="log_id")


def count_logs(logs: DataFrame, ids: Ids = None) -> DataFrame:
    return pick(logs, "run_id", ids).groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))


def log_page(logs: DataFrame, page_no: int = 0, size: int = C.LOG_PAGE, ids: Ids = None) -> DataFrame:
    """A page of each run's lines, newest first, with the total of the run."""
    upto = recent_logs(logs, (page_no + 1) * size, ids).filter(F.col("rn") > page_no * size)
    return upto.join(count_logs(logs, ids), "run_id")


def logs_since(logs: DataFrame, since: Column, ids: Ids = None) -> DataFrame:
    """Lines strictly after a time, oldest first within each run."""
    return logs_oldest_first(logs.filter(F.col("log_time") > since), ids)


def logs_after_retention(logs: DataFrame, cutoff: Column) -> DataFrame:
    """The snapshot that remains when older lines are dropped. With `log_date` the scan skips whole days."""
    kept = logs.filter(F.col("log_time") >= cutoff)
    return kept.filter(F.col("log_date") >= cutoff.cast("date")) if "log_date" in logs.columns else kept


def log_answer(
    logs: DataFrame, page_no: int = 0, size: int = C.LOG_PAGE, since: Column | None = None, ids: Ids = None
) -> DataFrame:
    """The log view of each run, in order: lines after `since`, oldest first, if it is given, else one page, newest
    first; the total counts all lines."""
    if since is not None:
        after, order = pick(logs.filter(F.col("log_time") > since), "run_id", ids), list(_NEWEST)
        lines = after.join(count_logs(logs, ids), "run_id")
    else:
        lines, order = log_page(logs, page_no, size, ids).drop("rn"), [F.desc(c) for c in _NEWEST]
    answer = lines.select(*logs.columns, "total", F.lit(page_no).alias("page"), F.lit(size).alias("size"))
    return answer.orderBy("run_id", *order)
