"""Building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions import keys as K

Ids = DataFrame | Sequence[str] | str | None


#: Columns by which stored tables are laid out, with the directory column and the expression that gives it.
BUCKETED = {"run_id": ("run_bucket", K.run_bucket), "name_key": ("name_bucket", K.name_bucket)}


def pick(df: DataFrame, on: str, ids: Ids) -> DataFrame:
    """Rows of the asked ids; none = all. Literals reach the scan as a filter, a DataFrame is a semi join. Where the table
    lies in directories by this column, the bucket is asked too: literals prune as the query is planned, a DataFrame as it
    runs."""
    if ids is None:
        return df
    bucket, of = BUCKETED.get(on, ("", None))
    bucketed = bucket in df.columns
    if isinstance(ids, DataFrame):
        asked = ids.select(F.col(ids.columns[0]).alias(on)).distinct()
        asked = asked.withColumn(bucket, of(on)) if bucketed else asked
        return df.join(asked, asked.columns, "left_semi").select(*df.columns)
    values = [ids] if isinstance(ids, str) else list(ids)
    picked = df.filter(F.col(on).isin(*values))
    return picked.filter(F.col(bucket).isin(*[of(F.lit(v)) for v in values])) if bucketed else picked


def newest(df: DataFrame, by: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """The last row per key in `order`, as an aggregate: each task sends one row per key, however hot the key."""
    row = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*by).agg(row.alias("row")).select("row.*")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, salt: str, ways: int = 32) -> DataFrame:
    """The first `k` rows per key with their rank `rn`, in two steps.

    Each key is first cut to `k` rows within `ways` slices, so that no task sorts a hot key alone; the second
    step sees at most `ways * k` rows per key. Both ranks are limited before their shuffle.
    """
    slice_no = F.pmod(F.xxhash64(salt), F.lit(ways))
    sliced = df.withColumn("slice", slice_no)
    first = Window.partitionBy(*by, "slice").orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    return (
        sliced.withColumn("rn", F.row_number().over(first))
        .filter(F.col("rn") <= k)
        .drop("slice", "rn")
        .withColumn("rn", F.row_number().over(final))
        .filter(F.col("rn") <= k)
    )


def page(df: DataFrame, order: Sequence[Column], page_no: int, size: int) -> DataFrame:
    """One page in a total order."""
    return df.orderBy(*order).offset(page_no * size).limit(size)


def with_totals(page_rows: DataFrame, everything: DataFrame, page_no: int, size: int) -> DataFrame:
    """Page rows with the totals of the whole; the count is a scalar subquery, not a join."""
    total = everything.select(F.count(F.lit(1)).alias("n")).scalar()
    _, _, pages = K.page_bounds(page_no, size, F.col("total_elements"))
    return page_rows.withColumn("total_elements", total).select(
        "*",
        pages.alias("total_pages"),
        F.lit(page_no).alias("current_page"),
        F.lit(size).alias("page_size"),
    )


def page_after(df: DataFrame, order: Sequence[str], last: Sequence, size: int) -> DataFrame:
    """The page following the row whose ascending order values are `last`: no skipped rows are sorted for it."""
    key = F.struct(*[F.col(c) for c in order])
    after = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, last, strict=True)])
    return df.filter(key > after).orderBy(*order).limit(size)
