"""Line deduplication by pairwise alignment.

Documents that share blocks are found by hashes of line runs: the shortest run of adjacent lines with `min_words` words that
starts at each line, and the shortest that ends at each line. Every line of a long enough block lies in such a run of the
block, so it is enough to pair each holder of a run with the run's first holder: no block is left out, and pairs grow with
the lines. Each pair is aligned with patience diff on its line hashes: lines that are unique in both documents
and in the same order are anchors, equal lines next to anchors join them, and the rest is aligned again until nothing is
found. A stretch without a unique line, as of a passage that one of the documents repeats, is anchored on the runs that both
hold, the n-th of one against the n-th of the other. What is left of the later document is aligned again with the whole
earlier one until no run of it is left, so blocks in another order are found. Only aligned blocks go: of two runs that overlap
and stand apart in the earlier document one is aligned, and what the other has beyond it stays if it is shorter than a block.
Common blocks of at least `min_words` words go from the later document, the one with the larger id. The first
holder of a line always keeps it.

Only hashes and word counts of lines (64 bits each) move before the last step; texts are read to hash their lines and to
cut them, and move once, for the cut.

Defined results: null and empty texts stay as they are; blank lines never link documents, but go with a block that holds
them; lines are compared without blanks around them; rows that repeat both id and text are one document and are cut alike; of
different texts under one id the one with the smaller hash is the earlier; a null id is earlier than all others; lines
repeated inside one document stay; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import column, stored


@dataclass(frozen=True)
class LineSettings:
    """`min_words`: shorter common blocks stay."""

    min_words: int = 10


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def line_runs(lines: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and hash of the shortest runs with `min_words` words that start at each line or end at it."""
    n, base = len(lines), 0x9E3779B97F4A7C15
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    place = np.arange(n)
    end = np.searchsorted(total, total[:-1] + min_words)
    start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    starts = np.concatenate([place[end <= n], start[start >= 0]])
    ends = np.concatenate([end[end <= n], place[start >= 0] + 1])
    # A polynomial of the lines; sums of stretches are shifted to power 0 by the inverse of the base.
    steps = (np.array([1] + [b] * n, dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    power, back = (np.cumprod(s, dtype=np.uint64) for s in steps)
    single = _mix(np.asarray(lines, dtype=np.int64).view(np.uint64) + np.uint64(base)) * power[:n]
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(single, dtype=np.uint64)])
    return starts, ends, _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)).view(np.int64)


class RunAnchors:
    """Runs of `min_words` words that both documents hold: in a stretch, the n-th of one against the n-th of the other."""

    def __init__(self, a: list[int], b: list[int], words: list[int], min_words: int) -> None:
        words_of = dict(zip(b, words, strict=True))
        # A line that b lacks ends a run at once: no run that holds it is a run of b.
        self.ends_a, self.runs_a = self._first_runs(a, [words_of.get(line, min_words) for line in a], min_words)
        self.ends_b, self.runs_b = self._first_runs(b, words, min_words)

    @staticmethod
    def _first_runs(lines: list[int], words: list[int], min_words: int) -> tuple[list[int], list[int]]:
        """End and hash of the run that starts at each line, as far as the words suffice."""
        before = np.cumsum([0, *words])
        n = int((before[:-1] + min_words <= before[-1]).sum())
        _, ends, runs = line_runs(np.array(lines, dtype=np.int64), np.array(words, dtype=np.int64), min_words)
        return ends[:n].tolist(), runs[:n].tolist()

    def close(self, taken: list[bool]) -> None:
        """Forget the runs of b that hold a line that is taken."""
        before = np.cumsum([0, *taken])
        ends = np.array(self.ends_b, dtype=np.int64)
        open_ = (ends <= len(taken)) & (before[np.minimum(ends, len(taken))] == before[: len(ends)])
        self.ends_b = np.where(open_, ends, len(taken) + 1).tolist()

    def __call__(self, a0: int, a1: int, b0: int, b1: int) -> dict[int, int]:
        places: dict[int, list[int]] = {}
        for i in range(a0, min(a1, len(self.runs_a))):
            if self.ends_a[i] <= a1:
                places.setdefault(self.runs_a[i], []).append(i)
        seen: Counter = Counter()
        found = {}
        for j in range(b0, min(b1, len(self.runs_b))):
            run = self.runs_b[j]
            if self.ends_b[j] <= b1 and seen[run] < len(places.get(run, ())):
                found[j] = places[run][seen[run]]
                seen[run] += 1
        return found

    def apart(self, chain: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Without the anchors that would break the run of the one before them."""
        kept: list[tuple[int, int]] = []
        for i, j in chain:
            if kept:
                p, q = kept[-1]
                if i - j != p - q and (i < self.ends_a[p] or j < self.ends_b[q]):
                    continue
            kept.append((i, j))
        return kept


def _line_anchors(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> dict[int, int]:
    """Place in b to place in a of the lines that are unique in both stretches."""
    times_a, times_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    place = {line: i for i, line in enumerate(a[a0:a1], a0) if times_a[line] == 1 and times_b.get(line) == 1}
    return {j: place[b[j]] for j in range(b0, b1) if b[j] in place}


def _longest_chain(anchors: dict[int, int]) -> list[tuple[int, int]]:
    """The longest run of anchors in the order of both: piles of patience sorting."""
    tops: list[int] = []
    piles: list[tuple[int, int, tuple | None]] = []
    for j, i in anchors.items():
        at = bisect_left(tops, i)
        tops[at : at + 1] = [i]
        piles[at : at + 1] = [(i, j, piles[at - 1] if at else None)]
    chain = []
    card = piles[-1] if piles else None
    while card:
        chain.append(card[:2])
        card = card[2]
    return chain[::-1]


def patience_pairs(a: list, b: list, runs: RunAnchors | None = None, by_lines: bool = True) -> list[tuple[int, int]]:
    """Places of equal lines in both lists, in order, by patience diff.

    Anchors of a stretch are the lines that are unique in both; where there are none, the runs that both hold.
    """
    found: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b), by_lines)]
    while waiting:
        a0, a1, b0, b1, lines = waiting.pop()
        while lines and a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while lines and a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        chain = _longest_chain(_line_anchors(a, b, a0, a1, b0, b1)) if lines else []
        if not chain and runs:
            chain = runs.apart(_longest_chain(runs(a0, a1, b0, b1)))
        for i, j in chain:
            waiting.append((a0, i, b0, j, True))
            found.append((i, j))
            a0, b0 = i + 1, j + 1
        if chain:
            waiting.append((a0, a1, b0, b1, True))
    return sorted(found)


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of b that are aligned with equal stretches of a and have enough words.

    What is left of b is aligned again until it holds no run of a that has enough words, so a block that stands in another
    order, or more often, is found as well. If anchors on single lines give no block, those on runs do.
    """
    runs = RunAnchors(a, b, words, min_words)
    left: list = list(b)
    taken = [False] * len(b)
    by_lines = True
    while runs(0, len(a), 0, len(b)):
        before = sum(taken)
        run: list[int] = []
        last = (-2, -2)
        for i, j in [*patience_pairs(a, left, runs, by_lines), (-2, -2)]:
            if run and (i, j) != (last[0] + 1, last[1] + 1):
                if sum(words[p] for p in run) >= min_words:
                    for p in run:
                        taken[p], left[p] = True, (p,)  # equal to no line
                run = []
            run.append(j)
            last = (i, j)
        by_lines = sum(taken) > before
        if by_lines:
            runs.close(taken)
    edges = np.flatnonzero(np.diff([False, *taken, False])).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(docs: DataFrame, key: str, text: str) -> Column:
    """A document's identity and order: id, then hash of the text."""
    return F.struct(column(docs, key).cast("long").alias("id"), F.xxhash64(column(docs, text)).alias("hash"))


def line_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, lines (hash per line, 0 for blank ones), words (per line)."""
    bare = F.transform(_lines(F.col("text")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    rows = docs.filter(column(docs, text).isNotNull()).select(_key(docs, key, text).alias("doc"), column(docs, text).alias("text"))
    return rows.select("doc", bare.alias("bare")).select(
        "doc",
        F.transform("bare", lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("lines"),
        F.transform("bare", lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))).alias("words"),
    )


def overlapping(tables: DataFrame, settings: LineSettings) -> DataFrame:
    """Pairs (early, late): each document that shares a run of lines with earlier ones, with the first that holds the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, waiting = [], [], 0
            for i, (lines, words) in enumerate(zip(batch.column("lines"), batch.column("words"), strict=True)):
                own = np.unique(line_runs(lines.values.to_numpy(), words.values.to_numpy(), settings.min_words)[2])
                rows.append(np.full(len(own), i))
                keys.append(own)
                waiting += len(own)
                if waiting > 100_000 or i == batch.num_rows - 1:
                    docs = batch.column("doc").take(pa.array(np.concatenate(rows)))
                    yield pa.record_batch([docs, pa.array(np.concatenate(keys))], names=["doc", "run"])
                    rows, keys, waiting = [], [], 0

    held = tables.mapInArrow(run, "doc struct<id: long, hash: long>, run long")
    firsts = held.groupBy("run").agg(F.min("doc").alias("early"), F.max("doc").alias("last")).filter("early < last").drop("last")
    return held.withColumnRenamed("doc", "late").join(firsts, "run").filter("early < late").select("early", "late").distinct()


def common_lines(pairs: DataFrame, tables: DataFrame, settings: LineSettings) -> DataFrame:
    """doc, place: lines to delete, from the alignment of each pair."""
    early = tables.select(F.col("doc").alias("early"), F.col("lines").alias("early_lines"))
    late = tables.select(F.col("doc").alias("late"), F.col("lines").alias("late_lines"), "words")
    both = pairs.join(early, "early").join(late, "late").select("late", "early_lines", "late_lines", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for batch in batches:
            ranges = [
                [{"from": x, "to": y} for x, y in common_blocks(a.as_py(), b.as_py(), w.as_py(), settings.min_words)]
                for a, b, w in zip(*(batch.column(n) for n in ("early_lines", "late_lines", "words")), strict=True)
            ]
            yield pa.record_batch([batch.column("late"), pa.array(ranges, kind)], names=["late", "ranges"])

    schema = "late struct<id: long, hash: long>, ranges array<struct<`from`: int, `to`: int>>"
    ranges = both.mapInArrow(run, schema).select("late", F.explode("ranges").alias("r"))
    return ranges.select(F.col("late").alias("doc"), F.explode(F.sequence(F.col("r.from"), F.col("r.to") - 1)).alias("place"))


def remove_common_lines(
    docs: DataFrame, settings: LineSettings = LineSettings(), key: str = "doc_id", text: str = "text", count: str | None = None
) -> DataFrame:
    """The documents without the blocks they share with earlier ones. `count` names a column for deleted lines."""
    tables = stored(line_tables(docs, key, text), "lines").dropDuplicates(["doc"])
    tables = stored(tables, "line-tables")
    places = common_lines(stored(overlapping(tables, settings), "pairs"), tables, settings)
    cuts = places.groupBy("doc").agg(F.collect_set("place").alias("cut")).select(F.col("doc.id").alias("k1"), F.col("doc.hash").alias("k2"), "cut")
    # Names of the key columns that clash with nothing.
    k1, k2, cut = ("_" * max(map(len, docs.columns)) + n for n in ("id", "hash", "cut"))
    cuts = cuts.toDF(k1, k2, cut)
    ident = _key(docs, key, text)
    rows = docs.withColumns({k1: ident["id"], k2: ident["hash"]})
    joined = rows.join(cuts, rows[k1].eqNullSafe(cuts[k1]) & (rows[k2] == cuts[k2]), "left").drop(cuts[k1]).drop(cuts[k2])

    def left(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
        return F.array_join(F.transform(places, lambda p: F.element_at(lines, p + 1)), "\n")

    # One list in a list: its lines are split once and bound to a name.
    shorter = F.element_at(F.transform(F.array(_lines(column(joined, text))), left), 1)
    changed = joined.withColumn(text, F.when(F.col(cut).isNull(), column(joined, text)).otherwise(shorter))
    columns = [column(changed, c) for c in docs.columns]
    if count:
        columns.append(F.coalesce(F.size(F.col(cut)), F.lit(0)).alias(count))
    return changed.select(*columns)
