"""Search of names by any part of them, over an index of short pieces.

The index has a posting (piece, name) for every piece of one to three signs of every different name, in lower case. A search
text asks for its own pieces, of three signs or of its length if that is less; names that hold all of them are compared with
the text. So a name is compared only with texts it nearly matches, and no text meets the whole catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import constants as C
from edgeloom.functions import keys as K
from edgeloom.functions import text as T
from edgeloom.operators.catalog import ASSET_ORDER
from edgeloom.operators.common import top_k

LONGEST = 3


def _pieces(text: Column, n: Column) -> Column:
    """The different pieces of `n` signs."""
    starts = F.sequence(F.lit(1), F.char_length(text) - n + 1)
    return F.when(F.char_length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def _named(assets: DataFrame, *keep: str) -> DataFrame:
    names = F.array_distinct(F.transform(F.array("short_name", "full_name"), lambda c: F.lower(F.coalesce(c, F.lit("")))))
    return assets.select(*keep, F.explode(names).alias("name")).filter("name <> ''")


def write_name_index(assets: DataFrame, out: str) -> None:
    """Postings of all different names, in directories by a bucket of the piece, sorted by it."""
    names = _named(assets).distinct()
    pieces = F.concat(*[_pieces(F.col("name"), F.lit(n)) for n in range(1, LONGEST + 1)])
    postings = names.select(F.explode(pieces).alias("piece"), "name").withColumn("piece_bucket", K.name_bucket("piece"))
    placed = postings.hint("rebalance", "piece_bucket").sortWithinPartitions("piece_bucket", "piece")
    placed.write.mode("overwrite").partitionBy("piece_bucket").parquet(out)


def read_name_index(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def matching_names(index: DataFrame, texts: DataFrame) -> DataFrame:
    """`text` and `name` for each search text (in lower case, trimmed) and each name that contains it."""
    size = F.least(F.lit(LONGEST), F.char_length("text"))
    asked = texts.select("text").distinct().filter("text <> ''").withColumn("pieces", _pieces(F.col("text"), size))
    asked = asked.select("text", F.size("pieces").alias("wanted"), F.explode("pieces").alias("piece"))
    asked = asked.withColumn("piece_bucket", K.name_bucket("piece"))
    met = asked.join(index, ["piece_bucket", "piece"]).groupBy("text", "name", "wanted").agg(F.count(F.lit(1)).alias("found"))
    return met.filter((F.col("found") == F.col("wanted")) & F.contains("name", "text")).select("text", "name")


def search_names(assets: DataFrame, index: DataFrame, queries: DataFrame, limit: int = C.SEARCH_LIMIT) -> DataFrame:
    """For each search text of `queries` (its first column), the first assets whose short or full name contains it, any case.
    Texts are trimmed and lowered; blank ones find nothing."""
    asked = queries.select(F.col(queries.columns[0]).alias("query")).distinct().withColumn("text", T.trim_lower(F.col("query")))
    columns = ["asset_id", "short_name", "full_name", "created_at"]
    found = matching_names(index, asked).join(_named(assets, *columns), "name").drop("name").dropDuplicates(["text", "asset_id"])
    best = top_k(found, ["text"], [F.asc(c) for c in ASSET_ORDER], limit, salt="asset_id")
    return asked.join(best, "text").select(
        "query",
        F.col("short_name").alias("entity_id"),
        F.col("full_name").alias("entity_name"),
        F.lit(C.ENTITY_TYPE).alias("entity_type"),
        "rn",
    )
