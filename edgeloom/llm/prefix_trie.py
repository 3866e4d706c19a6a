"""The trie of conversation prefixes, with totals over subtrees by a depth-band rollup.

1. Order. Turns are sorted over all partitions by conversation, turn, role and text, so that a conversation of any length
   is spread over tasks. A scan gives each turn its place and the sums of its prefix: two polynomials of the turns' hashes
   modulo 2**61 - 1. What a partition's last conversation adds up to is carried into the next; a few numbers per partition.
2. Rebuild. The sums of a rebuilt prefix follow from those of the two conversations it is put together from, without reading
   a text again. A node is known by its two sums; members with equal sums have equal prefixes, but for an accident with a
   chance of about pairs / 2**122.
3. Bands. Depths are cut into bands of `height`. A node learns the path from the top of its band from the turns of one of its
   conversations, at most `height` entries. Nodes add their numbers to the ancestors inside their band only. Band tops form
   a smaller trie, on which the same is done, until one band holds it; then the completed totals of the band tops are added
   to their ancestors in the band above. Rounds grow with the logarithm of the depth, and no row explodes to more than
   `height` others.

Defined results: turns are ordered null first, equal turns by role, then text, and equal rows all count; null role or text
is empty; rows without a conv_id belong to no conversation; conv_id is a long, and c - c % 100 keeps the sign of c; a
conversation may be rebuilt without a turn, and then ends at the root; without conversations the result is empty; other
columns are not read. The digest of a node's ends is made over its sorted ids as they stream by: a digest has no other
order than one id after the other, so the ids that end at one node pass through one task, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import column, stored
from edgeloom.session import work_dir

PRIME = (1 << 61) - 1
BASES = (1_409_286_153_437_209_231 % PRIME, 2_071_723_948_233_417_711 % PRIME)
HEAD = 5  # the most turns a conversation takes over


@dataclass(frozen=True)
class TrieSettings:
    """`share`: conversations of one block of so many ids take their first turns from its first id. `height`: of a band."""

    share: int = 100
    height: int = 8


# --- numbers modulo 2**61 - 1 ------------------------------------------------------------------------------------


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Products modulo the prime of numbers below it, by halves of 31 bits."""
    a, b = np.asarray(a, dtype=np.uint64), np.asarray(b, dtype=np.uint64)
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    middle = ah * bl + al * bh
    return _reduce(ah * bh * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + al * bl)


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _reduce(a + (np.uint64(PRIME) - b))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) <= n:
        out = np.concatenate([out, times(out, pow(base, len(out), PRIME))])
    return out[: n + 1]


def running(x: np.ndarray) -> np.ndarray:
    """Running sums modulo the prime."""
    low = np.uint64((1 << 31) - 1)
    return _reduce(times(_reduce(np.cumsum(x >> np.uint64(31))), 1 << 31) + _reduce(np.cumsum(x & low)))


# --- places and sums of the given turns --------------------------------------------------------------------------


class Scan:
    """Walks turns in order. The state is the conversation it stands in, the number of its turns so far and their sums."""

    def __init__(self, conv: int | None = None, n: int = 0, sums: tuple[int, int] = (0, 0)):
        self.conv, self.n, self.sums = conv, n, sums

    def __call__(self, conv: np.ndarray, terms: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The place of each turn in its conversation and the two sums up to it."""
        size = len(conv)
        starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
        start = np.repeat(starts, np.diff([*starts, size]))
        goes_on = conv[0] == self.conv
        ahead = self.n if goes_on else 0
        first = start == 0
        local = np.arange(size) - start + 1
        place, sums = np.where(first, local + ahead, local), []
        for base, x, before in zip(BASES, terms, self.sums, strict=True):
            weighted = times(x, powers(base, int(local.max()))[local])
            total = running(weighted)
            total = np.where(first, total, minus(total, total[np.maximum(start - 1, 0)]))
            if goes_on:
                total = np.where(first, _reduce(times(total, pow(base, ahead, PRIME)) + np.uint64(before)), total)
            sums.append(total)
        self.conv, self.n, self.sums = int(conv[-1]), int(place[-1]), (int(sums[0][-1]), int(sums[1][-1]))
        return place, sums


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _partition_ends(ordered: DataFrame) -> list:
    """Of each partition: its first conversation, and the state of a scan of it alone at its end."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, part, first = Scan(), None, None
        for batch in batches:
            if batch.num_rows:
                conv, x1, x2 = _numbers(batch, "conv_id", "x1", "x2")
                if part is None:
                    part, first = batch.column("part")[0].as_py(), int(conv[0])
                scan(conv, [x1.astype(np.uint64), x2.astype(np.uint64)])
        if part is not None:
            values = [part, first, scan.conv, scan.n, *scan.sums]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], ["part", "first", "conv", "n", "s1", "s2"])

    return ordered.mapInArrow(ends, "part long, first long, conv long, n long, s1 long, s2 long").orderBy("part").collect()


def _carried(ends: list) -> dict[int, tuple]:
    """The state in which a scan enters each partition."""
    out, state = {}, (None, 0, (0, 0))
    for e in ends:
        out[e.part] = state
        conv, n, sums = state
        if conv == e.first == e.conv:  # one conversation fills the partition
            sums = tuple((s + pow(b, n, PRIME) * x) % PRIME for s, b, x in zip(sums, BASES, (e.s1, e.s2), strict=True))
            state = (conv, n + e.n, sums)
        else:
            state = (e.conv, e.n, (e.s1, e.s2))
    return out


def placed_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per given turn: conv_id, place (from 1), s1 and s2 (sums of the prefix that ends with it), chars."""
    spark = conversations.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{work_dir(spark)}/checkpoints")
    turns = conversations.select(
        column(conversations, conv).cast("long").alias("conv_id"),
        column(conversations, turn).alias("turn"),
        F.coalesce(column(conversations, role), F.lit("")).alias("role"),
        F.coalesce(column(conversations, text), F.lit("")).alias("text"),
    ).filter(F.col("conv_id").isNotNull())

    def term(*salt: Column) -> Column:
        return F.pmod(F.xxhash64(*salt, "role", "text"), F.lit(PRIME - 1)) + 1

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "row"]  # by `row`, equal rows are spread too
    dealt = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    narrow = dealt.select("conv_id", term().alias("x1"), term(F.lit(29)).alias("x2"), F.char_length("text").cast("long").alias("chars"))
    # The checkpoint keeps partitions and their order, on which the scan rests.
    ordered = narrow.withColumn("part", F.spark_partition_id().cast("long")).checkpoint()
    states = spark.sparkContext.broadcast(_carried(_partition_ends(ordered)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for batch in batches:
            if batch.num_rows:
                scan = scan or Scan(*states.value[batch.column("part")[0].as_py()])
                conv, x1, x2 = _numbers(batch, "conv_id", "x1", "x2")
                at, sums = scan(conv, [x1.astype(np.uint64), x2.astype(np.uint64)])
                arrays = [batch.column("conv_id"), pa.array(at, pa.int64()), *[pa.array(s.astype(np.int64)) for s in sums], batch.column("chars")]
                yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "place", "s1", "s2", "chars"])

    return ordered.mapInArrow(place, "conv_id long, place long, s1 long, s2 long, chars long")


# --- rebuilt conversations ---------------------------------------------------------------------------------------


def rebuilt_members(turns: DataFrame, share: int) -> DataFrame:
    """Per rebuilt conversation and depth from 0: conv_id, depth, k1 and k2 (the node), chars (of the node's last text), last."""
    head = F.sort_array(F.collect_list(F.when(F.col("place") <= HEAD, F.struct("place", "s1", "s2", "chars"))))
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n"), head.alias("head"))
    own = convs.select("conv_id", "n", "head", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).alias("h"))
    first = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("taken"))
    joined = own.withColumn("base", F.expr(f"conv_id - conv_id % {share}")).join(first, "base", "left")
    taken = F.coalesce(F.slice("taken", 1, F.col("h")), F.expr("array()").cast("array<struct<place:long,s1:long,s2:long,chars:long>>"))
    joined = joined.withColumn("taken", F.when(F.col("h") > 0, taken).otherwise(F.slice("head", 1, 0)))
    joined = joined.withColumn("k", F.size("taken").cast("long")).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))

    def sum_at(runs: str, place: Column, s: str) -> Column:
        return F.coalesce(F.try_element_at(F.col(runs)[s], F.nullif(place.cast("int"), F.lit(0))), F.lit(0).cast("long"))

    rebuilt = stored(
        joined.select(
            "conv_id", "h", "k", "length", "taken",
            *[sum_at("taken", F.col("k"), s).alias(f"t{s[1]}") for s in ("s1", "s2")],
            *[sum_at("head", F.least("h", F.size("head")), s).alias(f"o{s[1]}") for s in ("s1", "s2")],
        ),
        "rebuilt",
    )
    root = F.array(F.struct(*[F.lit(0).cast("long").alias(c) for c in ("place", "s1", "s2", "chars")]))
    front = rebuilt.select("conv_id", "length", F.explode(F.concat(root, "taken")).alias("t"))
    front = front.select("conv_id", F.col("t.place").alias("depth"), F.col("t.s1").alias("k1"), F.col("t.s2").alias("k2"), F.col("t.chars").alias("chars"), (F.col("t.place") == F.col("length")).alias("last"))
    # The place of a taken turn is its depth. An own turn moves by k - h places, its sum by as many powers of the base.
    backs = [np.array([pow(pow(b, i, PRIME), -1, PRIME) for i in range(HEAD + 1)], dtype=np.uint64) for b in BASES]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, h, k, length = _numbers(batch, "place", "h", "k", "length")
            keys = []
            for i, back in zip("12", backs, strict=True):
                s, o, t = (x.astype(np.uint64) for x in _numbers(batch, f"s{i}", f"o{i}", f"t{i}"))
                keys.append(_reduce(t + times(minus(s, o), back[h - k])).astype(np.int64))
            depth = place - h + k
            arrays = [batch.column("conv_id"), pa.array(depth), *map(pa.array, keys), batch.column("chars"), pa.array(depth == length)]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "depth", "k1", "k2", "chars", "last"])

    rest = turns.join(rebuilt.drop("taken"), "conv_id").filter(F.col("place") > F.col("h"))
    return front.unionByName(rest.mapInArrow(move, "conv_id long, depth long, k1 long, k2 long, chars long, last boolean"))


# --- bands and totals --------------------------------------------------------------------------------------------


def band_paths(members: DataFrame, step: int, height: int) -> DataFrame:
    """Members at depths divisible by `step`, each with `level` (depth / step) and the path (level, k1, k2) of the members of its
    conversation from the top of the band above it or around it; a band top has the whole band above."""
    level = F.expr(f"depth div {step}")
    band = F.expr(f"(depth div {step} - 1) div {height}")
    above = F.when(level == 0, F.array(F.lit(0).cast("long"))).when(level % height == 0, F.array(band, band + 1)).otherwise(F.array(band))
    chosen = members.filter(F.col("depth") % step == 0).select("*", level.alias("level"), F.explode(above).alias("band"))
    rows = F.sort_array(F.collect_list(F.struct("level", "k1", "k2", "chars", "last")))
    run = F.transform("run", lambda x: F.struct(x["level"].alias("level"), x["k1"].alias("k1"), x["k2"].alias("k2")))
    each = chosen.groupBy("conv_id", "band").agg(rows.alias("run")).select("conv_id", run.alias("keys"), F.posexplode("run").alias("at", "row"))
    each = each.filter((F.col("at") > 0) | (F.col("row.level") == 0))  # the first of a run is the last of another, but for the root
    return each.select("conv_id", "row.*", F.slice("keys", F.lit(1), F.col("at")).alias("path"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k1", "k2").agg(F.max("level").alias("level"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_totals(values: DataFrame, members: DataFrame, step: int, height: int, deepest: int, paths: DataFrame | None = None) -> DataFrame:
    """Sums of `leaves` and `saved` over the subtrees of the nodes at depths divisible by `step`.

    `values` has the numbers of each such node; `paths` its band path, made here where it isn't given."""
    if step > deepest:
        return values.select("k1", "k2", F.lit(0).cast("long").alias("level"), "leaves", "saved")  # the root alone
    if paths is None:
        paths = band_paths(members, step, height).groupBy("k1", "k2").agg(F.first("level").alias("level"), F.first("path").alias("path"))
    nodes = stored(paths.join(values.select("k1", "k2", "leaves", "saved"), ["k1", "k2"]), "band")
    top = F.col("level") % height == 0
    own = F.array(F.struct("level", "k1", "k2"))
    inside = nodes.select(F.explode(F.when(top, own).otherwise(F.concat("path", own))).alias("to"), "leaves", "saved").select("to.*", "leaves", "saved")
    within = stored(_summed(inside), "within")
    if step * height > deepest:
        return within
    tops = within.filter(top)
    above = subtree_totals(tops, members, step * height, height, deepest)
    lower = nodes.filter(top & (F.col("level") > 0)).select("k1", "k2", "path").join(above.select("k1", "k2", "leaves", "saved"), ["k1", "k2"])
    passed = lower.select(F.explode("path").alias("to"), "leaves", "saved").select("to.*", "leaves", "saved")
    return _summed(within.unionByName(passed))


def end_digests(members: DataFrame) -> DataFrame:
    """Per node at which conversations end: SHA-256 of their ids, ascending, joined by commas."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([sha.hexdigest()])], ["k1", "k2", "ends_sha256"])

        for batch in batches:
            k1, k2, conv = _numbers(batch, "k1", "k2", "conv_id")
            starts = np.concatenate([[0], np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1]) if len(k1) else []
            for a, b in zip(starts, [*starts[1:], len(k1)], strict=True):
                ids = ",".join(map(str, conv[a:b].tolist())).encode()
                if now == (int(k1[a]), int(k2[a])):
                    sha.update(b"," + ids)
                    continue
                if now is not None:
                    yield done()
                now, sha = (int(k1[a]), int(k2[a])), hashlib.sha256(ids)
        if now is not None:
            yield done()

    ends = members.filter("last").select("k1", "k2", "conv_id").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")
    return ends.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", settings: TrieSettings = TrieSettings()
) -> DataFrame:
    """Per node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = stored(placed_turns(conversations, conv, turn, role, text), "turns")
    members = stored(rebuilt_members(turns, settings.share), "members")
    deepest = members.agg(F.max("depth")).first()[0] or 0
    nodes = band_paths(members, 1, settings.height).groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("level").alias("level"), F.first("chars").alias("chars"),
        F.every("last").alias("childless"), F.first("path").alias("path"),
    )
    nodes = stored(nodes, "nodes")
    values = nodes.select("k1", "k2", "level", F.col("childless").cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    totals = subtree_totals(values, members, 1, settings.height, deepest, nodes.select("k1", "k2", "level", "path"))
    parent = F.try_element_at("path", F.lit(-1))
    linked = nodes.select("k1", "k2", "conv_id", "level", "n_convs", parent["k1"].alias("p1"), parent["k2"].alias("p2"))
    children = linked.filter(F.col("level") > 0).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    found = linked.join(totals.select("k1", "k2", "leaves", "saved"), ["k1", "k2"]).join(children, ["k1", "k2"], "left")
    found = found.join(end_digests(members), ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left")
    return found.select(
        "conv_id", F.col("level").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
