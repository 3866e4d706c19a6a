"""Ids, buckets and page arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom import constants as C


def stable_id(*parts: Column | str) -> Column:
    """Id from the natural key, so that a rerun gives the same id. A null part has a mark of its own."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0002")) for c in cols]), 256)


def asset_id(run_id: Column | str, short_name: Column | str) -> Column:
    return stable_id(run_id, short_name)


def run_bucket(run_id: Column | str) -> Column:
    """Storage bucket of a run. A literal run id folds to a constant, which prunes directories. The hash is the one by which
    Spark puts rows together, so a part of rows that lie together by run holds few buckets, or a share of one."""
    c = F.col(run_id) if isinstance(run_id, str) else run_id
    return F.pmod(F.hash(c), F.lit(C.RUN_BUCKETS)).cast("int")


def name_bucket(name_key: Column | str) -> Column:
    """Storage bucket of a name in upper case; folds to a constant for a literal."""
    c = F.col(name_key) if isinstance(name_key, str) else name_key
    return F.pmod(F.xxhash64(c), F.lit(C.NAME_BUCKETS)).cast("int")


def arrival(*extra: str) -> Column:
    """Total order of arrival, as one comparable value."""
    return F.struct(*[F.col(c) for c in (*C.ARRIVAL, *extra)])


def page_bounds(page: int, size: int, total: Column) -> tuple[Column, Column, Column]:
    """First row, row after the last, and number of pages; bounds are clamped to the total."""
    start = F.least(F.lit(page * size).cast("bigint"), total)
    stop = F.least(start + F.lit(size), total)
    return start, stop, F.ceil(total / F.lit(size)).cast("bigint")
