"""Replays and conflicts of landed lines, told from event keys and digests of the text alone.

A line that repeats the key and the text of another is a replay and goes. Another text under a key in use is no replay: the
first in text order is the event, each other text is set aside once, as `key_conflict`. A line refused for other reasons
has no dependable key and is known by its text. Only keys and digests are shuffled to find these lines; all other lines,
usually nearly all, are decoded where they were read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as C
from edgeloom.session import work_dir
from edgeloom.sources.events import REFUSED, decode, parse_envelope

DIGEST = ["d1", "d2"]

#: Up to so many odd lines (two numbers and a flag each) are sent to all tasks; beyond it their lines are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def with_digest(lines: DataFrame, text: str = "value") -> DataFrame:
    """128 bits of each line's text."""
    return lines.withColumns({"d1": F.xxhash64(text), "d2": F.xxhash64(F.lit(31), text)})


def line_keys(lines: DataFrame) -> DataFrame:
    """Key, digest and text of each line. A refused line has a key of its own: no run, and its digest."""
    usable = F.col("reason").isNull()
    keyed = with_digest(parse_envelope(lines), "line")
    own = dict(zip(C.EVENT_KEY, (F.lit(""), F.col("d1"), F.col("d2")), strict=True))
    return keyed.select(*[F.when(usable, F.col(c)).otherwise(own[c]).alias(c) for c in C.EVENT_KEY], *DIGEST, F.col("line").alias("value"))


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _written(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{work_dir(spark)}/edgeloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def odd_lines(lines: DataFrame) -> DataFrame | None:
    """Digests of the lines that are replayed or share their key with another text: d1, d2, taken. None if there are none.

    `taken` says that the key is in use by an event not among these lines, here never. Keys are counted before the shuffle,
    and only if some occur twice are the lines read again for their digests."""
    keys = line_keys(lines)
    more = _written(keys.groupBy(*C.EVENT_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "odd-keys")
    if not (n := more.count()):
        return None
    odd = keys.join(_few(more, n), C.EVENT_KEY, "left_semi").select(*DIGEST).distinct()
    return _written(odd.withColumn("taken", F.lit(False)), "odd-lines")


def has_repeats(decoded: DataFrame) -> bool:
    """Whether the decoded rows of a log, one per line, hold a key or a refused line twice. Rows that lie together by run are
    counted where they lie; only refused lines, known by the digests of their texts, are shuffled."""
    refused = F.coalesce(F.col("reason").isin(*REFUSED), F.lit(False))
    keys = decoded.filter(~refused).groupBy(*C.EVENT_KEY).agg(F.count(F.lit(1)).alias("n"))
    texts = with_digest(decoded.filter(refused), "line").groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("n"))
    twice = F.max(F.col("n") > 1).alias("twice")
    return any(df.agg(twice).first().twice for df in (keys, texts))


def settled(lines: DataFrame, odd: DataFrame | None) -> DataFrame:
    """Envelopes of the lines, one for each event and one for each text that is set aside."""
    if odd is None or not (n := odd.count()):
        return parse_envelope(lines)
    few = _few(odd, n)
    marked = with_digest(lines.select("value"))
    plain = parse_envelope(marked.join(few, DIGEST, "left_anti").select("value"))
    # One of the copies that a task holds is as good as another, so a line replayed very often sends one row per task.
    once = marked.join(few, DIGEST).groupBy(*DIGEST).agg(F.first("value").alias("value"), F.first("taken").alias("taken"))
    again = parse_envelope(once, "taken")
    in_use = F.col("reason").isNull()
    first = again.filter(in_use).groupBy(*C.EVENT_KEY).agg(F.min("line").alias("first_line"))
    judged = again.join(first, C.EVENT_KEY, "left")
    conflict = in_use & (F.col("taken") | (F.col("line") != F.col("first_line")))
    odd_ones = judged.withColumn("reason", F.when(conflict, "key_conflict").otherwise(F.col("reason")))
    return plain.unionByName(odd_ones.drop("taken", "first_line"))


def decode_lines(lines: DataFrame, replays: bool = True) -> DataFrame:
    """Lines to decoded events. `replays=False` skips the search for logs known to hold each event once.

    The search runs at once: lists of odd keys and lines are written to the shared folder, and their size decides how they
    are joined."""
    return decode(settled(lines, odd_lines(lines) if replays else None))
