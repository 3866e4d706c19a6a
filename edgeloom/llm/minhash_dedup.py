"""Near-duplicate documents by an inverted join of signature coordinates.

1. Sketch: the distinct shingles of five words, as 64-bit hashes; a digest of the set; a MinHash signature. A document is
   then a set of (coordinate, value) postings. Equal shingle sets are one class and go on as one representative.
2. Postings that no other class has can't collide and fall away. If a pair must agree in `matches` coordinates of n, it
   shares one of the n - matches + 1 rarest postings of each (prefix filter in the order of frequency), so a class posts
   only those; one with fewer than `matches` shared postings posts none and is skipped.
3. The classes that meet at a posting count their agreements. Each posting list gives the links of a spanning forest, not
   all pairs. Long lists are cut into blocks whose tiles cover every pair of blocks.
4. The forests join to candidate groups, which hold every pair that agrees in enough coordinates. Their full shingle sets
   are read again, and links are confirmed on them, again as forests per tile of bounded blocks.
5. Components of the confirmed links.

With similarity 0.85 and 32 coordinates a linked pair agrees in fewer than 17 with a probability of about 3.5 in a
million, and it is linked all the same if a chain of others connects it.

Defined results: null text, empty text and text without words have an empty set, n_shingles 0, and are linked with
nothing; fewer than five words are one shingle; repeated ids are one node, also where their texts differ or some have no words; a null id has component null; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import column, stored
from edgeloom.llm.components import components
from edgeloom.llm.groups import Forest, dealt_by, streamed, tiles
from edgeloom.llm.words import kept


@dataclass(frozen=True)
class MinHashSettings:
    """Links need similarity of at least `percent`. `list_block` and `set_block` bound what a task compares at once."""

    percent: int = 85
    words: int = 5
    coordinates: int = 32
    matches: int = 17
    list_block: int = 1024
    set_block: int = 128
    seed: int = 17

    def linked(self, common: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (size_a + size_b - common)


class Shingler:
    """Shingle sets of texts as sorted distinct 64-bit hashes; hashes of words are kept up to a bound."""

    LIMIT = 500_000

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        try:
            hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            if len(known) > self.LIMIT:
                known.clear()
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(known))
            hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(self.words, len(words))
        mixed = np.full(len(words) - size + 1, len(words) if size < self.words else 0, dtype=np.uint64)
        for k in range(size):
            mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(words) - size + 1 + k])
        return np.unique(mixed)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sketches(docs: DataFrame, settings: MinHashSettings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set digest (h1, h2), postings: coordinate in the high bits, value in the low 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = kept(f"shingler {settings.words}", lambda: Shingler(settings.words))
        rng = np.random.default_rng(settings.seed)
        factors = rng.integers(1, 1 << 63, settings.coordinates, dtype=np.uint64) | np.uint64(1)
        places = np.arange(settings.coordinates, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            sizes, first, second, posted = [], [], [], []
            for value in batch.column(1):
                own = shingles(value.as_py())
                sizes.append(len(own))
                first.append(int(_mix(own).sum(dtype=np.uint64)) if len(own) else 0)
                second.append(int(np.bitwise_xor.reduce(_mix(own + np.uint64(settings.seed)))) if len(own) else 0)
                low = np.full(settings.coordinates, np.uint64(0xFFFFFFFF))
                for at in range(0, len(own), 4096):
                    values = _mix(own[at : at + 4096, None] * factors[None, :]) >> np.uint64(32)
                    low = np.minimum(low, values.min(axis=0))
                posted.append((low | places).astype(np.int64) if len(own) else np.empty(0, dtype=np.int64))
            digest = [pa.array(np.array(h, dtype=np.uint64).view(np.int64)) for h in (first, second)]
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), *digest, pa.array(posted, pa.list_(pa.int64()))]
            yield pa.record_batch(arrays, names=["doc_id", "n_shingles", "h1", "h2", "postings"])

    schema = "doc_id long, n_shingles long, h1 long, h2 long, postings array<long>"
    return docs.select(column(docs, key).cast("long"), column(docs, text)).mapInArrow(run, schema)


def prefixes(classes: DataFrame, settings: MinHashSettings) -> DataFrame:
    """token, df, rep, n_shingles, shared: the rarest postings each class must be found by."""
    posted = classes.select("rep", "n_shingles", F.explode("postings").alias("token"))
    often = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = (
        posted.join(often, "token")
        .groupBy("rep", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
        .filter(F.size("shared") >= settings.matches)
    )
    rarest = F.slice("shared", F.lit(1), F.size("shared") - (settings.matches - 1))
    return shared.select("rep", "n_shingles", F.col("shared.token").alias("shared"), F.explode(rarest).alias("p")).select(
        "p.token", "p.df", "rep", "n_shingles", "shared"
    )


def forest_links(n: int, low: np.ndarray, compare) -> list[tuple[int, int]]:
    """Links of a spanning forest over n items. compare(i, others) says which of `others` are linked with i.

    `low` tells the two blocks of a tile apart: items of one block are compared only in the tile of that block alone.
    """
    links, waiting = [], np.ones(n, dtype=bool)
    apart = low.any() and not low.all()
    if apart:
        forest = Forest(n)
        right = np.flatnonzero(~low)
        for i in np.flatnonzero(low):
            for j in right[compare(i, right)]:
                if forest.join(int(i), int(j)):
                    links.append((int(i), int(j)))
        return links
    for source in range(n):
        if not waiting[source]:
            continue
        waiting[source] = False
        queue = [source]
        while queue:
            i = queue.pop()
            others = np.flatnonzero(waiting)
            if not len(others):
                return links
            found = others[compare(i, others)]
            waiting[found] = False
            queue.extend(found.tolist())
            links.extend((int(i), int(j)) for j in found)
    return links


def _in_tiles(rows: DataFrame, many: str, size: int) -> DataFrame:
    """Cut groups of `many` rows into blocks of about `size` and copy each row to the tiles of its block."""
    blocks = F.ceil(F.col(many) / size).cast("long")
    cut = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    return cut.withColumn("tile", F.explode(tiles(F.col("block"), F.col("blocks"))))


def _low_block(group: pa.Table) -> np.ndarray:
    tile, blocks = group["tile"][0].as_py(), group["blocks"][0].as_py()
    return group["block"].to_numpy() == tile // blocks


def candidate_links(posted: DataFrame, settings: MinHashSettings) -> DataFrame:
    """Links of forests over the pairs that meet at a posting and agree in at least `matches` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in streamed(batches, ["token", "tile"]):
            n = group.num_rows
            if n < 2:
                continue
            reps, sizes = group["rep"].to_numpy(), group["n_shingles"].to_numpy()
            shared = group["shared"].combine_chunks()
            counts = np.diff(shared.offsets.to_numpy())
            values = shared.flatten().to_numpy()
            lines = np.repeat(np.arange(n), counts)
            signature = np.full((n, settings.coordinates), -1, dtype=np.int64)
            signature[lines, values >> 32] = values & 0xFFFFFFFF
            absent = signature < 0

            def compare(i: int, others: np.ndarray, signature=signature, absent=absent, sizes=sizes) -> np.ndarray:
                fits = (100 * sizes[others] >= settings.percent * sizes[i]) & (100 * sizes[i] >= settings.percent * sizes[others])
                agree = ((signature[others] == signature[i]) & ~absent[i]).sum(axis=1)
                return fits & (agree >= settings.matches)

            for i, j in forest_links(n, _low_block(group), compare):
                a.append(reps[i])
                b.append(reps[j])
            if len(a) > 100_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    cut = _in_tiles(posted, "df", settings.list_block)
    return dealt_by(cut.select("token", "tile", "blocks", "block", "rep", "n_shingles", "shared"), "token", "tile").mapInArrow(run, "a long, b long")


def shingle_sets(texts: DataFrame, settings: MinHashSettings) -> DataFrame:
    """The column `text` turned into `shingles`: sorted 64-bit hashes as bytes. All other columns stay."""
    others = [f for f in texts.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = kept(f"shingler {settings.words}", lambda: Shingler(settings.words))
        for batch in batches:
            sets = [make(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.record_batch([*[batch.column(f.name) for f in others], pa.array(sets, pa.binary())], names=[*[f.name for f in others], "shingles"])

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in others], "shingles binary"])
    return texts.mapInArrow(run, schema)


def confirmed_links(members: DataFrame, settings: MinHashSettings) -> DataFrame:
    """Links of forests over the pairs of a candidate group whose full sets are similar enough.

    members: component, many (size of the group), rep, shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in streamed(batches, ["component", "tile"]):
            n = group.num_rows
            if n < 2:
                continue
            reps = group["rep"].to_numpy()
            sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in group["shingles"].combine_chunks()]
            sizes = np.array([len(s) for s in sets])
            _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
            lines = np.repeat(np.arange(n), sizes)
            order = np.argsort(numbers, kind="stable")
            holders, ends = lines[order], np.cumsum(np.bincount(numbers))
            begins = np.concatenate([[0], ends[:-1]])
            own = np.split(numbers, np.cumsum(sizes)[:-1])

            def compare(i: int, others: np.ndarray, sizes=sizes, own=own, holders=holders, begins=begins, ends=ends, n=n) -> np.ndarray:
                from_, to = begins[own[i]], ends[own[i]]
                span = to - from_
                at = np.repeat(from_ - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
                common = np.bincount(holders[at], minlength=n)[others]
                return settings.linked(common, sizes[others], sizes[i])

            links = forest_links(n, _low_block(group), compare)
            if links:
                a, b = np.array(links).T
                yield pa.record_batch([pa.array(reps[a]), pa.array(reps[b])], names=["a", "b"])

    cut = _in_tiles(members, "many", settings.set_block)
    return dealt_by(cut.select("component", "tile", "blocks", "block", "rep", "shingles"), "component", "tile").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, settings: MinHashSettings = MinHashSettings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    sketched = stored(sketches(docs, settings, key, text), "sketches")
    usable = sketched.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    found = usable.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("postings").alias("postings"))
    classes = stored(found, "classes")

    candidates = components(candidate_links(prefixes(classes, settings), settings))
    many = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("many"))
    members = stored(candidates.join(many, "component").withColumnRenamed("node", "rep"), "candidates")
    ids = docs.select(column(docs, key).cast("long").alias("rep"), column(docs, text).alias("text"))
    sets = shingle_sets(members.join(ids, "rep").select("component", "many", "rep", "text"), settings)
    links = confirmed_links(sets, settings)
    # Rows of one id with different texts are one node: the classes that hold them meet in the id.
    own = sketched.filter(F.col("doc_id").isNotNull())
    texts = F.struct("h1", "h2", "n_shingles")
    several = own.groupBy("doc_id").agg(F.min(texts).alias("one"), F.max(texts).alias("other")).filter("one <> other").select("doc_id")
    several = stored(several, "ids-of-several-texts")
    shared = not several.isEmpty()
    if shared:
        met = usable.select("doc_id", "h1", "h2", "n_shingles").join(several, "doc_id").join(classes, ["h1", "h2", "n_shingles"])
        links = links.union(met.select("doc_id", "rep"))
    linked = stored(components(links), "near-components")

    named = classes.select("h1", "h2", "n_shingles", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    found = sketched.join(named, ["h1", "h2", "n_shingles"], "left").select("doc_id", "n_shingles", "component")
    if shared:  # also a row without words is of the node of its id
        of_id = several.join(linked.withColumnRenamed("node", "doc_id"), "doc_id").withColumnRenamed("component", "of_id")
        found = found.join(of_id, "doc_id", "left").withColumn("component", F.coalesce("of_id", "component"))
    return found.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each_group(docs: DataFrame, settings: MinHashSettings = MinHashSettings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, unchanged, without near duplicates: of each group the one with the smallest id stays.

    Rows of one id are one document, of which one row stays; rows without an id or without words all stay.
    """
    found = near_duplicates(docs, settings, key, text)
    name = "_" * max(map(len, docs.columns)) + "id"
    gone = found.filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    left = docs.join(gone, column(docs, key).cast("long") == gone[name], "left_anti")
    return left.filter(column(left, key).isNotNull()).dropDuplicates([key]).union(left.filter(column(left, key).isNull()))
