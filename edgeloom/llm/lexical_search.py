"""Ranked lexical search: many queries at once, with the sums of terms that queries share worked out once.

1. The items' terms are mined for shared sets. Each item's terms (with repeats) stand in one order, the terms of most
   items first; then neighbours that stand together in two items or more become one node, again and again. What comes
   out is a graph in which a node is the sum of two others and an item the sum of a few nodes.
2. One pass over the whole texts keeps of each document its number of terms and the counts of the terms that are asked.
   From this table come the corpus statistics: documents, terms, documents per asked term.
3. Documents are scored in blocks. A block's accumulators - one row per node, one column per document - are filled once,
   leaves from the counts, nodes in the order of the graph, and every item adds up the nodes it is made of.
4. A task keeps the best of each item among its documents; a rank over these gives the answer. No document is left out
   before it is scored, and a task sends `top` rows per item at most, so neither a frequent term nor a large group of
   equal documents grows what is shuffled.

The items travel with the tasks. They are taken in blocks of `item_bytes` of text (one longer item is a block of its own),
and each block of items is a pass over the documents. The score of a term t of weight w in a document with count tf is
w * ((1000000000 * tf) div (1000 * tf + 12 * m)), m = 100 - 25 + ((25 * n * N) div L), all in whole numbers.

Defined results: null and empty texts and texts without terms hold none, and count for none of the statistics; an item
without terms, or whose terms no document holds, has no rows; several rows of one item_id are one item with the terms of
its different texts; repeated documents are ranked each; equal scores go by doc_id, null first; without documents or
items the result is empty. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import column, stored
from edgeloom.llm.words import sliced

# One byte for each of 256: A-Z become small, other signs below 0x80 but for digits and letters a space. Bytes from 0x80 on
# are parts of letters beyond ASCII and stay.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return (text or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class SearchSettings:
    """`item_bytes` bounds the items of a pass, `cells` the accumulators a task holds at once."""

    top: int = 20
    item_bytes: int = 4_000_000
    cells: int = 4_000_000


class QueryGraph:
    """Items as sums of nodes. Nodes 0..len(terms)-1 are the terms; each round of `rounds` adds sums of two earlier nodes."""

    def __init__(self, bags: list[Counter]):
        held = Counter(term for bag in bags for term in bag)
        self.terms = sorted(held, key=lambda t: (-held[t], t))
        at = {t: i for i, t in enumerate(self.terms)}
        self.items = [sorted(i for t, n in bag.items() for i in [at[t]] * n) for bag in bags]
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = len(self.terms)
        while self._merge():
            pass

    def _merge(self) -> bool:
        """One round: neighbours of two items or more become a node; where two such pairs overlap, the more frequent one."""
        shared = Counter(p for nodes in self.items for p in set(zip(nodes, nodes[1:], strict=False)))
        new: dict[tuple[int, int], int] = {}
        for k, nodes in enumerate(self.items):
            out, i = [], 0
            while i < len(nodes):
                pair, after = tuple(nodes[i : i + 2]), tuple(nodes[i + 1 : i + 3])
                if len(pair) == 2 and shared[pair] > 1 and shared[pair] >= (shared[after] if len(after) == 2 else 0):
                    out.append(new.setdefault(pair, self.size + len(new)))
                    i += 2
                else:
                    out.append(nodes[i])
                    i += 1
            self.items[k] = out
        if new:
            self.size += len(new)
            self.rounds.append((np.array([a for a, _ in new]), np.array([b for _, b in new])))
        return bool(new)

    def sums(self, leaves: np.ndarray) -> Iterator[np.ndarray]:
        """Scores of each item from the terms' values: one row per term, one column per document."""
        acc = np.zeros((self.size, leaves.shape[1]), dtype=np.int64)
        acc[: len(leaves)] = leaves
        at = len(leaves)
        for left, right in self.rounds:
            np.add(acc[left], acc[right], out=acc[at : at + len(left)])
            at += len(left)
        for nodes in self.items:
            yield acc[nodes].sum(axis=0) if nodes else np.zeros(leaves.shape[1], dtype=np.int64)


class Best:
    """The best documents of one item so far."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.scores, self.known, self.ids = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.least)
        if not len(good):
            return
        self.scores = np.concatenate([self.scores, scores[good]])
        self.known = np.concatenate([self.known, known[good]])
        self.ids = np.concatenate([self.ids, ids[good]])
        order = np.lexsort((self.ids, self.known, -self.scores))[: self.top]
        self.scores, self.known, self.ids = self.scores[order], self.known[order], self.ids[order]
        if len(order) == self.top:
            self.least = int(self.scores[-1])


def asked_counts(documents: DataFrame, vocabulary: list[bytes], doc: str, text: str) -> DataFrame:
    """Per document with terms: doc_id, n (all its terms), `term` and `tf` (the asked ones, by their number, and their counts)."""
    known = documents.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in sliced(batches, 2048):
            rows, n, ends, term, tf = [], [], [0], [], []
            for i, text in enumerate(batch.column("text")):
                words = terms_of(text.as_py())
                if not words:
                    continue
                counts = Counter(words)
                asked = [(number[t], counts[t]) for t in counts.keys() & number.keys()]
                rows.append(i)
                n.append(len(words))
                term += [t for t, _ in asked]
                tf += [c for _, c in asked]
                ends.append(len(term))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((term, pa.int32()), (tf, pa.int64()))]
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])

    narrow = documents.select(column(documents, doc).cast("long").alias("doc_id"), column(documents, text).cast("binary").alias("text"))
    return narrow.filter(F.col("text").isNotNull()).mapInArrow(count, "doc_id long, n long, term array<int>, tf array<long>")


def weights(counts: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """The weight of each asked term, N and L. The rows that reach the driver are one per asked term."""
    total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    n, length = total[0], total[1] or 0
    df = np.zeros(n_terms, dtype=np.int64)
    for t, c in counts.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        df[t] = c
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64), n, length


def best_of_tasks(counts: DataFrame, graph: QueryGraph, weight: np.ndarray, n: int, length: int, settings: SearchSettings) -> DataFrame:
    """The best documents of each item in each task: item (its number), doc_id, score."""
    sent = counts.sparkSession.sparkContext.broadcast((graph, weight))
    width = max(1, settings.cells // max(1, graph.size))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weight = sent.value
        best = [Best(settings.top) for _ in graph.items]
        for batch in sliced(batches, width):
            size = batch.num_rows
            m = np.array([75 + 25 * x * n // length for x in batch.column("n").to_pylist()], dtype=np.int64)
            term, tf = batch.column("term"), batch.column("tf").flatten().to_numpy()
            doc = np.repeat(np.arange(size), np.diff(term.offsets.to_numpy()))
            term = term.flatten().to_numpy()
            leaves = np.zeros((len(weight), size), dtype=np.int64)
            leaves[term, doc] = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            known = ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            for one, scores in zip(best, graph.sums(leaves), strict=True):
                one.add(scores, known, ids)
        for k, one in enumerate(best):
            if len(one.ids):
                ids = pa.array(one.ids, pa.int64(), mask=~one.known)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k), pa.int32()), ids, pa.array(one.scores)], ["item", "doc_id", "score"])

    return counts.mapInArrow(score, "item int, doc_id long, score long")


def _blocks(items: DataFrame, limit: int) -> Iterator[dict]:
    """Items with the different texts of each, in blocks of about `limit` bytes."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // limit)
    for b in range(blocks):
        bags: dict[object, Counter] = {}
        for item_id, text in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).distinct().collect():
            bags.setdefault(item_id, Counter()).update(terms_of(text.encode()))
        yield bags


def rank_documents(
    documents: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    settings: SearchSettings = SearchSettings(),
) -> DataFrame:
    """The best documents of each item: item_id, rank, doc_id (as a long), score."""
    spark = documents.sparkSession
    asked = items.select(column(items, item).alias("item_id"), column(items, item_text).alias("text")).filter(F.col("text").isNotNull())
    kind = asked.schema["item_id"].dataType.simpleString()
    answer = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for bags in _blocks(asked, settings.item_bytes):
        graph = QueryGraph(list(bags.values()))
        counts = stored(asked_counts(documents, graph.terms, doc, text), "asked")
        weight, n, length = weights(counts, len(graph.terms))
        ids = spark.createDataFrame(list(enumerate(bags)), f"item int, item_id {kind}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        found = best_of_tasks(counts, graph, weight, n, length, settings).withColumn("rank", F.row_number().over(order))
        ranked = found.filter(F.col("rank") <= settings.top).join(ids, "item")
        answer = answer.union(ranked.select("item_id", "rank", "doc_id", "score"))
    return answer
