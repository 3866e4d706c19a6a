"""Best-fit packing of tokenized documents into sequences of at most `capacity` tokens.

Large-item matching: pieces above a third of the capacity come at most two to a sequence, so they are matched in pairs,
the longest first, each with the longest partner that still fits. Smaller pieces then go, the longest first, into the
tightest gap that takes them, and into new sequences when no gap does.

Lengths are whole numbers up to the capacity, so the plan is made on their histogram (one count per length, never more
than `capacity`), whatever the number of pieces. Spark ranks the pieces of each length, and the plan turns a rank into a
sequence and a place in it. No group of pieces is ever gathered.

Defined results: a null or empty text is the end id alone; only documents longer than the capacity are cut, into full
pieces, the first of them shorter; repeated rows are packed each; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import column, in_small_batches, stored
from edgeloom.llm.words import SegmentCache, as_uint32, in_groups, kept, sliced

CAPACITY, END_ID = 2048, 0
#: Pieces of one length are ranked in chunks of about so many.
CHUNK = 250

# White space of the tokenizer's pattern beyond blank, tab and line ends; a text that holds any is encoded whole.
_RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_SPACE = " \t\n\r"
_SEGMENT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")


class ByteBpe:
    """Texts to ids, exactly as the tokenizer encodes them whole.

    Segments start with white space that follows something else, where the words of byte-level BPE always start.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks already fill the cores
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)  # a token is written with one character for each of its bytes
        self.cache = SegmentCache(self._segments)

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _segments(self, segments: list[str]) -> list[bytes]:
        """Those that start with white space and end in something else are encoded as one text, cut again by their bytes."""
        joined = [s for s in segments if s[0] in _SPACE and s[-1] not in _SPACE]
        ids = as_uint32(self._batch(["".join(joined)])[0])
        ends = np.concatenate([[0], np.cumsum(self.widths[ids])])
        bounds = np.cumsum([0, *(len(s) if s.isascii() else len(s.encode()) for s in joined)])
        at = np.searchsorted(ends, bounds)
        if not np.array_equal(ends[np.minimum(at, len(ids))], bounds):  # not a byte-level model with these cuts
            return self._batch(segments)
        packed, cuts = ids.tobytes(), (4 * at).tolist()
        found = {s: packed[a:b] for s, a, b in zip(joined, cuts, cuts[1:], strict=False)}
        others = [s for s in segments if s not in found]
        found.update(zip(others, self._batch(others), strict=True))
        return [found[s] for s in segments]

    def _whole(self, text: str) -> bool:
        return bool(_RARE_SPACE.search(text)) or any(s in text for s in self.specials)

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        for group in in_groups(texts):
            cut = [None if self._whole(t) else _SEGMENT.findall(t) for t in group]
            self.cache.learn([c for c in cut if c])
            for text, segments in zip(group, cut, strict=True):
                yield self.cache.encode(segments) if segments is not None else self._batch([text])[0]


def read_text_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_pieces(
    docs: DataFrame,
    tokenizer_json: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Tokenize documents and cut the long ones: doc_id, row_id, piece, start, length, ids_crc32, and ids on request."""
    schema = "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(tokenizer_json, lambda: ByteBpe(tokenizer_json))
        end, width = np.array([end_id], dtype="<u4").tobytes(), 4
        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(6 + keep_ids)]
            doc_ids, row_ids, texts = (batch.column(i).to_pylist() for i in range(3))
            encoded = bpe.encode_texts([t or "" for t in texts])
            for doc_id, row_id, packed in zip(doc_ids, row_ids, encoded, strict=True):
                ended = memoryview(packed + end)
                total = len(ended) // width
                first = (total - 1) % capacity + 1
                cuts = [0, *range(first, total + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    made = [doc_id, row_id, piece, a, b - a, zlib.crc32(ended[width * a : width * b])]
                    for to, v in zip(out, [*made, as_uint32(ended[width * a : width * b]).tolist()] if keep_ids else made, strict=True):
                        to.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * keep_ids
            names = ["doc_id", "row_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    source = docs.select(column(docs, key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), column(docs, text).alias("text"))
    return in_small_batches(source).mapInArrow(run, schema)


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, how many, first sequence, offset).

    The pieces of such a run fill one sequence each, in order. Sequences are kept as runs of equal content with a gap.
    """
    left = {n: c for n, c in counts.items() if c}
    placed: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = {}
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of (first sequence, how many)
    open_gaps = 0  # bit g is set if there are sequences with gap g
    sequences = 0

    def put(length: int, count: int, first: int, gap: int) -> None:
        """Place `count` pieces of a length into as many sequences that have this gap."""
        nonlocal open_gaps
        placed.append((length, used.get(length, 0), count, first, capacity - gap))
        used[length] = used.get(length, 0) + count
        left[length] -= count
        if rest := gap - length:
            gaps.setdefault(rest, []).append((first, count))
            open_gaps |= 1 << rest

    def new(length: int, count: int) -> int:
        nonlocal sequences
        first, sequences = sequences, sequences + count
        put(length, count, first, capacity)
        return first

    def take(gap: int, most: int) -> tuple[int, int]:
        """Take at most `most` sequences of a gap."""
        nonlocal open_gaps
        first, count = gaps[gap].pop()
        if count > most:
            gaps[gap].append((first + most, count - most))
        if not gaps[gap]:
            open_gaps &= ~(1 << gap)
        return first, min(count, most)

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        while left[length]:
            partner = next((n for n in large if n <= capacity - length and left[n]), None)
            if partner is None:
                new(length, left[length])
            elif partner == length:
                pairs = left[length] // 2
                if not pairs:
                    new(length, 1)
                    continue
                first = new(length, pairs)
                first, count = take(capacity - length, pairs)
                put(length, count, first, capacity - length)
            else:
                count = min(left[length], left[partner])
                new(length, count)
                first, count = take(capacity - length, count)
                put(partner, count, first, capacity - length)
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            fitting = open_gaps >> length
            if fitting:
                gap = length + (fitting & -fitting).bit_length() - 1
                first, count = take(gap, left[length])
                put(length, count, first, gap)
            else:
                whole = capacity // length
                new(length, max(1, left[length] // whole))
    return placed


def _ranked(pieces: DataFrame, counts: dict[int, int], capacity: int) -> DataFrame:
    """Number the pieces of each length from 0. A frequent length is split into chunks, so no task holds all of one."""
    chunks = F.array(*[F.lit(max(1, -(-counts.get(n, 0) // CHUNK))) for n in range(capacity + 1)])
    many = F.element_at(chunks, (F.col("length") + 1).cast("int"))
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("row_id", "piece"), many))
    sizes = dealt.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("row_id", "piece")) - 1
    return dealt.withColumn("inside", inside).join(starts, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("inside"))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored pieces."""
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per length
    placed = sorted(packing_plan(counts, capacity))
    lengths = np.array([p[0] for p in placed], dtype=np.int64)
    ranks, firsts, offsets = (np.array([p[i] for p in placed], dtype=np.int64) for i in (1, 3, 4))
    edges = np.searchsorted(lengths, np.arange(capacity + 2))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, rank):
        import pandas as pd

        n, r = length.to_numpy(), rank.to_numpy()
        at = np.empty(len(n), dtype=np.int64)
        for one in np.unique(n):
            own = n == one
            a, b = edges[one], edges[one + 1]
            at[own] = a + np.searchsorted(ranks[a:b], r[own], side="right") - 1
        return pd.DataFrame({"sequence_id": firsts[at] + r - ranks[at], "offset": offsets[at]})

    ranked = _ranked(pieces, counts, capacity).withColumn("place", place("length", "rank"))
    return ranked.select(*pieces.columns, "place.sequence_id", "place.offset")


def sequences(packed: DataFrame, ids: Column | str = "ids") -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids, one row each (of at most `capacity` ids)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.col(ids) if isinstance(ids, str) else ids)))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p[ids if isinstance(ids, str) else "ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """Tokenize, cut and pack. The tokenizer file is read by the driver and sent along; it does not grow with the data."""
    pieces = token_pieces(docs, read_text_file(tokenizer_path), capacity=capacity, **options)
    return pack_pieces(stored(pieces, "pieces"), capacity)
