"""Sharding by a two-pass external shuffle.

Pass one scatters whole records: a seeded hash of the key chooses the shard, a second seeded hash of the key and of the
row's place in the input chooses one of the shard's buckets, each small enough for memory. Pass two puts every bucket in
an order fixed by the hashes, shuffles it with Fisher-Yates (`shuffle` of Spark is that algorithm) and writes it.

The shard follows the law `key`: only the key and the number of shards decide, and with one more shard rows move only
into the new one. A row is in shard j if j is the last number for which hash(key, j) is divisible by j + 1.

Defined results: a null key is a key like others; a null text has size 16 and checksum 0; repeated rows stay, each
with its own slot (they share a shard, never a bucket by force); an empty table gives an empty result; other columns
travel along in `record`, so their names clash with nothing. Columns must be orderable (no maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import column, scratch_path

RECORD_OVERHEAD = 16


def shard_of(key: Column, shards: int, seed: int = 0) -> Column:
    """The shard of a key among `shards`: consistent, so shard_of(k, n + 1) is shard_of(k, n) or n."""
    moves = F.filter(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda j: F.pmod(F.xxhash64(F.lit(seed), key, j), j + 1) == 0,
    )
    return F.array_max(moves)


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + RECORD_OVERHEAD


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = 40,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 7,
    bucket_bytes: int = 16 << 20,
) -> DataFrame:
    """Write `docs` to `path`, one directory per shard, and return what was written.

    Columns: record (the row as it was), bucket, pos (place in the bucket), shard. A file holds whole buckets in order.
    """
    shard = shard_of(column(docs, key), shards, seed).alias("shard")
    weights = docs.select(shard, record_size(column(docs, text)).alias("size")).groupBy("shard").agg(F.sum("size"))
    buckets = [1] * shards
    for number, total in weights.collect():  # a row per shard
        buckets[number] = -(-total // bucket_bytes)

    tag = F.xxhash64(F.lit(seed + 1), column(docs, key), F.monotonically_increasing_id())
    fields = [column(docs, c).alias(c) for c in docs.columns]
    per_shard = F.array(*map(F.lit, buckets))
    scattered = docs.select(shard, F.struct(tag.alias("tag"), F.struct(*fields).alias("record")).alias("item")).select(
        "shard",
        F.pmod(F.xxhash64(F.lit(seed + 2), "item.tag"), F.element_at(per_shard, F.col("shard") + 1)).cast("int").alias("bucket"),
        "item",
    )
    shuffled = scattered.groupBy("shard", "bucket").agg(
        F.shuffle(F.sort_array(F.collect_list("item")), seed).alias("items")
    )
    rows = shuffled.select("shard", "bucket", F.posexplode("items").alias("pos", "item")).select(
        F.col("item.record").alias("record"), "bucket", "pos", "shard"
    )
    rows.sortWithinPartitions("shard", "bucket", "pos").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def with_slots(rows: DataFrame, written: DataFrame) -> DataFrame:
    """Add `slot`, the gapless place in its shard, to rows of what was written: buckets follow one another.

    `rows` may hold fewer or derived columns beside shard, bucket and pos, so that records need not move again.
    """
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    return rows.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("pos")).drop("start")


def shard_digest(docs: DataFrame, shards: int = 40, seed: int = 7, **options) -> DataFrame:
    """Shard the documents and describe each written record: size, checksum, shard, slot, shard with one more."""
    written = write_shards(docs, scratch_path(docs.sparkSession, "shards"), shards, seed=seed, **options)
    doc_id, text = F.col("record.doc_id"), F.col("record.text")
    described = written.select(
        "shard",
        "bucket",
        "pos",
        doc_id.alias("doc_id"),
        record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return with_slots(described, written).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
    )
