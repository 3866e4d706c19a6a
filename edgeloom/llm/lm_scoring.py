"""Language-model scores from a hidden Markov model.

A word is lower-cased A-Z and has no ASCII white space in it; each text ends in one more token. The model has a few
latent states, and every training word has a chance of its own in each of them. In each round Baum-Welch counts are
summed over all training texts, task by task and then by Spark. The rounds start with tied words: the `own` most frequent words are
classes of their own, all others share classes by their last bytes, and a class emits its words by their counts. In the
last round the words part: expected counts by (word, state) are summed for the whole
vocabulary, so what the model gathers grows with the corpus. A word's chance is `1 - tied` times its expected share of
the state and `tied` times that of the tied model, which also has the words that training did not see. The scaled
forward recursion sums over all state paths of a whole text, so the score is the exact probability under the model.

The numbers of the `head` most frequent words go along with the tasks (a fixed number of words; those over 64 bytes are
known by a digest). All other words are a table: each text sends its words there and gets their counts and states back,
so neither driver nor task ever holds the vocabulary. On that way the states of a word are shares of eight bits.

Defined results: null or empty text is the end token alone; repeated rows are scored each; without training texts all
counts are 0 and the model has the end token only, so score is 0 for an empty text and minus infinity is never given:
an unknown word has the mass of half a count. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.chains import forward, forward_backward, side_by_side
from edgeloom.llm.common import column, id_remainder, stored
from edgeloom.llm.words import sliced

END = b"\n"  # no word can hold a line end
LONGEST_HEAD_WORD = 64
TOKENS_OF_A_TASK = 3_000_000

#: Numbers and words of texts, which zstd makes a quarter smaller than Spark's usual codec does.
CODEC = "zstd"


@dataclass(frozen=True)
class HmmSettings:
    """`states`: 8 at most. `head`: words whose numbers travel with tasks. `own`: of these, words that the tied rounds
    have as classes of their own. `suffixes`: their classes of the other words. `sample_rounds`: tied rounds that give the
    starting values; `rounds`: tied rounds after them, before the last. All rounds go over all training texts. Only if a
    `sample` is asked for, those that give the starting values take the texts in turn: as many shares as rounds, fewer if a
    share had less than `sample` texts. `tied`: weight of the tied model at the end."""

    states: int = 8
    head: int = 131_072
    own: int = 16_384
    suffixes: int = 2_048
    sample: int | None = None
    sample_rounds: int = 8
    rounds: int = 1
    tied: float = 0.5
    seed: int = 5

    def __post_init__(self):
        if not 1 <= self.states <= 8:
            raise ValueError("1 to 8 states")

    @property
    def classes(self) -> int:
        return self.own + self.suffixes

    def suffix_class(self, word: bytes) -> int:
        return self.own + zlib.crc32(word[-3:]) % self.suffixes


def words_of(text: str | None) -> list[bytes]:
    """`bytes.split` cuts at exactly blank, tab, LF, VT, FF and CR; `bytes.lower` touches A-Z only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def head_key(word: bytes) -> bytes:
    """The word, or a digest that no word can be (it holds a line end)."""
    return word if len(word) <= LONGEST_HEAD_WORD else b"\n" + hashlib.md5(word).digest()


def head_key_column(word: Column) -> Column:
    digest = F.concat(F.lit(b"\n"), F.unhex(F.md5(word)))
    return F.when(F.octet_length(word) <= LONGEST_HEAD_WORD, word).otherwise(digest)


def count_words(texts: DataFrame, settings: HmmSettings) -> DataFrame:
    """word (binary), suffix class, n: summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) > 500_000:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    suffix = settings.own + F.crc32(F.substring("word", -3, 3)) % settings.suffixes
    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).select("word", suffix.cast("int").alias("suffix"), "n")


@dataclass(frozen=True)
class Vocabulary:
    """What tasks know of the counts: the head words, and totals."""

    settings: HmmSettings
    head: dict[bytes, tuple[int, int]]  # word: (class, count)
    total: int
    distinct: int
    suffix_mass: np.ndarray  # sum of (count + 0.5) over a suffix class, and 0.5 for unknown words
    class_counts: np.ndarray

    @property
    def base_log(self) -> float:
        return math.log10(self.total + 0.5 * (self.distinct + 1))


def read_vocabulary(counts: DataFrame, settings: HmmSettings) -> Vocabulary:
    """Totals, the head and the sums of the suffix classes: all of fixed size."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # The words by steps of a logarithmic scale of counts; of the step that does not fit as a whole, a share by hash.
    steps = counts.groupBy(F.floor(16 * F.log2("n")).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    room, chosen = settings.head, F.lit(False)
    for r in steps.orderBy(F.desc("step")).collect():
        if r.words > room:
            chosen = chosen | ((F.col("n") >= r.least) & (F.pmod(F.xxhash64("word"), F.lit(r.words)) < room))
            break
        room -= r.words
        chosen = F.col("n") >= r.least
    rows = counts.filter(chosen).select(head_key_column(F.col("word")).alias("word"), "suffix", "n").collect()
    head_rows = sorted(rows, key=lambda r: (-r.n, bytes(r.word)))[: settings.head]
    head, class_counts = {}, np.zeros(settings.classes)
    mass = np.full(settings.classes, 0.5)
    for r in counts.groupBy("suffix").agg(F.sum(F.col("n") + F.lit(0.5)).alias("m"), F.sum("n").alias("n")).collect():
        mass[r.suffix] += r.m
        class_counts[r.suffix] += r.n
    for rank, r in enumerate(head_rows):
        word = bytes(r.word)
        own = rank < settings.own
        head[word] = (rank if own else r.suffix, r.n)
        if own:
            class_counts[rank] = r.n
            class_counts[r.suffix] -= r.n
            mass[r.suffix] -= r.n + 0.5
    return Vocabulary(settings, head, total, distinct, mass, class_counts)


class _Numbers(dict):
    """Words of the head and their numbers; any other word gets -1 less its place among the other words of the text."""

    places: dict[bytes, int]

    def __missing__(self, word: bytes) -> int:
        if len(word) > LONGEST_HEAD_WORD and (at := self.get(head_key(word))) is not None:
            return at
        return -1 - self.places.setdefault(word, len(self.places))


def _packed(items: np.ndarray) -> bytes:
    """Numbers by their bytes, all lowest first: the higher ones are nearly all alike."""
    return zlib.compress(items.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _items(classes: np.ndarray, packed: bytes, own: int) -> np.ndarray:
    """The words of a text: the place in the head of a word with a class of its own is that class, `packed` has all others."""
    items = classes.astype("<i4")
    if len(packed):
        items[classes >= own] = _unpacked(packed)
    return items


def _suffixes(classes: np.ndarray, items: np.ndarray, size: int) -> np.ndarray:
    """The classes of a text's words outside the head."""
    suffixes, other = np.zeros(size, dtype=np.int64), items < 0
    suffixes[-1 - items[other]] = classes[other]
    return suffixes


def encode_texts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each text as class numbers, which also tell words with a class of their own; `rest` has the other words in turn: a place
    in the head, or -1 less a place in the text's own list of words outside it."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    schema = (
        "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
        "classes binary, rest binary, words array<binary>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        settings, base_log = voc.settings, voc.base_log
        head = _Numbers((w, i) for i, w in enumerate(voc.head))
        head_class = np.array([c for c, _ in voc.head.values()] or [0], dtype=np.int64)
        head_count = np.log10(np.array([n for _, n in voc.head.values()] or [0]) + 0.5)
        for batch in sliced(batches):
            rows = []
            row_ids, doc_ids, held, texts = (batch.column(i).to_pylist() for i in range(4))
            for row_id, doc_id, out, text in zip(row_ids, doc_ids, held, texts, strict=True):
                words = words_of(text)
                head.places = places = {}
                at = np.fromiter(map(head.__getitem__, words), dtype=np.int32, count=len(words))
                known = at >= 0
                suffixes = np.array([settings.suffix_class(w) for w in places], dtype="<u2")
                classes = np.where(known, head_class[np.maximum(at, 0)], 0).astype("<u2")
                classes[~known] = suffixes[-1 - at[~known]]
                base = head_count[at[known]].sum() - len(words) * base_log
                rest = at[classes >= settings.own]
                packed = classes.tobytes(), _packed(rest) if len(rest) else b"", list(places)
                rows.append((row_id, doc_id, out, len(words), int(known.sum()), base, *packed))
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
            types += [pa.binary(), pa.binary(), pa.list_(pa.binary())]
            cols = zip(*rows, strict=True) if rows else [[] for _ in types]
            names = [part.split()[0] for part in schema.split(", ")]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes


def first_guess(vocabulary: Vocabulary) -> Hmm:
    """Each state a random distortion of the class counts, so states can part."""
    s = vocabulary.settings
    rng = np.random.default_rng(s.seed)
    emit = (vocabulary.class_counts + 0.5) * np.exp(rng.normal(0, 1, (s.states, s.classes)))
    move = np.full((s.states, s.states), 0.1 / s.states) + np.eye(s.states) * 0.9
    return Hmm(np.full(s.states, 1 / s.states), move, emit / emit.sum(axis=1, keepdims=True))


def _unpack(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype="<u2") for v in batch.column(at)]


def baum_welch_round(encoded: DataFrame, model: Hmm, vocabulary: Vocabulary) -> Hmm:
    """One re-estimation over all texts of `encoded`: expected counts by task, summed by Spark, then normalised."""
    settings = vocabulary.settings
    k = settings.states
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    names = [f"s{i}" for i in range(k)]

    # Rows of the result: one for each class; then one for each state that is left, and one for the start.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = shared.value
        emit_by_class = np.ascontiguousarray(hmm.emit.T)
        counts = np.zeros((settings.classes + k + 1, k))
        for batch in batches:
            for _, items, running in side_by_side(_unpack(batch, 0)):
                gamma, moves, _ = forward_backward(emit_by_class[items], running, hmm.start, hmm.move)
                flat = items.ravel()
                for s in range(k):
                    counts[: settings.classes, s] += np.bincount(flat, gamma[:, :, s].ravel(), settings.classes)
                counts[settings.classes : -1] += moves
                counts[-1] += gamma[0].sum(axis=0)
        used = np.flatnonzero(counts.any(axis=1))
        yield pa.record_batch([pa.array(used), *[pa.array(counts[used, s]) for s in range(k)]], names=["row", *names])

    schema = "row long, " + ", ".join(f"{n} double" for n in names)
    summed = encoded.select("classes").mapInArrow(run, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    counts = np.zeros((settings.classes + k + 1, k))
    if summed.num_rows:
        counts[summed["row"].to_numpy()] = np.stack([summed[n].to_numpy() for n in names], axis=1)
    prior = vocabulary.class_counts + 0.5
    emit = counts[: settings.classes].T + 5 * prior / prior.sum()
    move = counts[settings.classes : -1] + 1 / k
    start = counts[-1] + 1 / k
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def train(encoded: DataFrame, vocabulary: Vocabulary) -> Hmm:
    """The tied model: every round goes over every training text, unless the settings ask for shares in the first ones."""
    s = vocabulary.settings
    every = encoded.filter(~F.col("held_out"))
    shares = 1 if s.sample is None else max(1, min(s.sample_rounds, every.count() // max(1, s.sample)))
    share = F.pmod(F.xxhash64(F.lit(s.seed), "doc_id", "row_id"), F.lit(shares))
    # A task gives up to one row per class, so it should read many more tokens than that.
    tasks = 1 + vocabulary.total // shares // TOKENS_OF_A_TASK
    model = first_guess(vocabulary)
    for i in range(s.sample_rounds):
        texts = every if shares == 1 else every.filter(share == i % shares)
        model = baum_welch_round(texts.select("classes").coalesce(tasks), model, vocabulary)
    for _ in range(s.rounds):
        model = baum_welch_round(every, model, vocabulary)
    return model


def sequence_scores(encoded: DataFrame, model: Hmm) -> DataFrame:
    """Adds `chain`: log10 of the probability of the class sequence under the tied model."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kept = ["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base"]
    schema = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, chain double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = shared.value
        emit_by_class = np.ascontiguousarray(hmm.emit.T)
        for batch in batches:
            chain = np.zeros(batch.num_rows)
            for own, items, running in side_by_side(_unpack(batch, len(kept))):
                _, log_sum = forward(emit_by_class[items], running, hmm.start, hmm.move)
                chain[own] = log_sum / math.log(10)
            yield pa.record_batch([*batch.columns[: len(kept)], pa.array(chain)], names=[*kept, "chain"])

    return encoded.select(*kept, "classes").mapInArrow(run, schema)


def _tied_emissions(model: Hmm, voc: Vocabulary, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Chances of words in each state under the tied model, from their classes and counts: words x states."""
    own = classes < voc.settings.own
    return model.emit.T[classes] * np.where(own, 1.0, (counts + 0.5) / voc.suffix_mass[classes])[:, None]


def _places(items: list[np.ndarray], others: np.ndarray, head: int) -> list[np.ndarray]:
    """Words of each text as rows of one table: the head, then the other words of all texts in turn."""
    first = head + np.concatenate([[0], np.cumsum(others)[:-1]]).astype(np.int64)
    return [np.where(it >= 0, it, a - 1 - it.astype(np.int64)) for it, a in zip(items, first, strict=True)]


def expected_counts(encoded: DataFrame, model: Hmm, vocabulary: Vocabulary) -> DataFrame:
    """The last expectation step, by words. Head words: `pos` and summed counts by state, per task; after them one row for
    each state that is left, and one for the start. Other words: row_id, pos, word, n, `shares` by text; n is 0 if held out."""
    k, head, own_classes = vocabulary.settings.states, len(vocabulary.head), vocabulary.settings.own
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    names = [f"s{i}" for i in range(k)]
    schema = "row_id long, pos int, word binary, n int, shares long, " + ", ".join(f"{n} float" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = shared.value
        emit_by_class = np.ascontiguousarray(hmm.emit.T)
        counts = np.zeros((head + k + 1, k))
        for batch in sliced(batches, 2048):
            held = batch.column(1).to_numpy(zero_copy_only=False)
            every = _unpack(batch, 2)
            classes = [c[:0] if out else c for c, out in zip(every, held, strict=True)]
            words = batch.column(4)
            sizes = words.value_lengths().to_numpy()
            flat_words = words.flatten()
            places = _places([_items(c, v.as_buffer(), own_classes) for c, v in zip(every, batch.column(3), strict=True)], sizes, head)
            told = np.zeros((len(flat_words), k))
            for own, items, running in side_by_side(classes):
                gamma, moves, _ = forward_backward(emit_by_class[items], running, hmm.start, hmm.move)
                flat = np.concatenate([places[i] for i in own])
                each = np.concatenate([gamma[: len(classes[i]), c] for c, i in enumerate(own)])
                for s in range(k):
                    found = np.bincount(flat, each[:, s], head + len(told))
                    counts[:head, s] += found[:head]
                    told[:, s] += found[head:]
                counts[head:-1] += moves
                counts[-1] += gamma[0].sum(axis=0)
            n = np.rint(told.sum(axis=1)).astype(np.int32)
            eighths = np.rint(255 * told / np.maximum(told.sum(axis=1), 1e-300)[:, None]).astype(np.uint64)
            shares = np.bitwise_or.reduce(eighths << (8 * np.arange(k, dtype=np.uint64)), axis=1).view(np.int64)
            pos = (np.arange(len(n)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            rows = np.repeat(batch.column(0).to_numpy(), sizes)
            nothing = pa.nulls(len(n), pa.float32())
            yield pa.record_batch([pa.array(rows), pa.array(pos), flat_words, pa.array(n), pa.array(shares), *[nothing] * k], names=["row_id", "pos", "word", "n", "shares", *names])
        used = np.flatnonzero(counts.any(axis=1))
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64())
        row_id, word, n, shares = (pa.nulls(len(used), kind) for kind in kinds)
        sums = [pa.array(counts[used, s].astype(np.float32)) for s in range(k)]
        yield pa.record_batch([row_id, pa.array(used.astype(np.int32)), word, n, shares, *sums], names=["row_id", "pos", "word", "n", "shares", *names])

    # A task gives up to one row per head word, so it should read many more tokens than that.
    few = encoded.select("row_id", "held_out", "classes", "rest", "words").coalesce(1 + vocabulary.total // TOKENS_OF_A_TASK)
    return few.mapInArrow(run, schema)


def _share(shares: Column, state: int) -> Column:
    return F.shiftrightunsigned(shares, 8 * state).bitwiseAND(F.lit(255))


def other_words(expected: DataFrame, states: int) -> DataFrame:
    """row_id, pos, n, times, shares: for each text's other words that training has, the count of the word, how many texts
    hold it, and its states by all of them. A word outside the head is never frequent, so no window is large."""
    word = Window.partitionBy("word")
    one_text = [_share(F.col("shares"), s) for s in range(states)]
    whole = F.greatest(reduce(lambda a, b: a + b, one_text), F.lit(1))
    summed = expected.filter(F.col("row_id").isNotNull()).select(
        "row_id",
        "pos",
        F.sum("n").over(word).alias("n"),
        F.count(F.lit(1)).over(word).alias("times"),
        *[F.sum(F.col("n") * one_text[s] / whole).over(word).alias(f"s{s}") for s in range(states)],
    )
    parts = [F.shiftleft(F.rint(255 * F.col(f"s{s}") / F.col("n")).cast("long"), 8 * s) for s in range(states)]
    return summed.filter(F.col("n") > 0).select("row_id", "pos", "n", "times", reduce(lambda a, b: a.bitwiseOR(b), parts).alias("shares"))


@dataclass(frozen=True)
class WordHmm:
    """The model with words: chances of the head words, and what gives those of all others."""

    start: np.ndarray
    move: np.ndarray
    head: np.ndarray  # words x states
    tied: Hmm
    totals: np.ndarray  # expected tokens of each state
    weight: float  # of the tied model

    def others(self, voc: Vocabulary, classes: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
        k = len(self.totals)
        parts = ((shares.view(np.uint64)[:, None] >> (8 * np.arange(k, dtype=np.uint64))) & np.uint64(255)).astype(float)
        parts *= (counts / np.maximum(parts.sum(axis=1), 1))[:, None]
        return self.weight * _tied_emissions(self.tied, voc, classes, counts) + (1 - self.weight) * parts / self.totals


def untie(expected: DataFrame, others: DataFrame, model: Hmm, vocabulary: Vocabulary) -> WordHmm:
    """The last maximisation step. The driver sees the sums of the head words and the totals of the states."""
    s = vocabulary.settings
    k, head = s.states, len(vocabulary.head)
    names = [f"s{i}" for i in range(k)]
    summed = expected.filter(F.col("row_id").isNull()).groupBy("pos").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    counts = np.zeros((head + k + 1, k))
    if summed.num_rows:
        counts[summed["pos"].to_numpy()] = np.stack([summed[n].to_numpy() for n in names], axis=1)
    shares = [_share(F.col("shares"), i) for i in range(k)]
    whole = F.greatest(reduce(lambda a, b: a + b, shares), F.lit(1)) * F.col("times")
    rest = others.agg(*[F.coalesce(F.sum(F.col("n") * p / whole), F.lit(0.0)) for p in shares]).first()
    totals = counts[:head].sum(axis=0) + np.array(rest)
    weight = s.tied if totals.all() else 1.0  # nothing to part without training texts
    totals = np.where(totals > 0, totals, 1.0)
    classes, seen = (np.array([v[i] for v in vocabulary.head.values()], dtype=np.int64) for i in (0, 1))
    emit = weight * _tied_emissions(model, vocabulary, classes, seen) + (1 - weight) * counts[:head] / totals
    move, start = counts[head:-1] + 1 / k, counts[-1] + 1 / k
    return WordHmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit, model, totals, weight)


def word_scores(encoded: DataFrame, others: DataFrame, model: WordHmm, vocabulary: Vocabulary) -> DataFrame:
    """row_id, doc_id, held_out, n_tokens, n_known, base_score, score of each text, by the scaled forward recursion."""
    spark = encoded.sparkSession
    small = Vocabulary(vocabulary.settings, {}, vocabulary.total, vocabulary.distinct, vocabulary.suffix_mass, vocabulary.class_counts)
    shared = spark.sparkContext.broadcast((model, small))
    kept = ["row_id", "doc_id", "held_out", "n_tokens"]
    schema = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, voc = shared.value
        head = len(hmm.head)
        for batch in sliced(batches):
            told = _unpack(batch, 6)
            items = [_items(c, v.as_buffer(), voc.settings.own) for c, v in zip(told, batch.column(7), strict=True)]
            sizes = np.array([max(0, -int(it.min(initial=0))) for it in items], dtype=np.int64)
            places = _places(items, sizes, head)
            found = batch.column(8)
            row = np.repeat(np.arange(batch.num_rows), found.value_lengths().fill_null(0).to_numpy())
            pos, n, shares = (f.to_numpy() for f in found.flatten().flatten())
            at = (np.cumsum(sizes) - sizes)[row] + pos
            counts, states = np.zeros(sizes.sum(), dtype=np.int64), np.zeros(sizes.sum(), dtype=np.int64)
            counts[at], states[at] = n, shares
            classes = np.concatenate([_suffixes(c, it, size) for c, it, size in zip(told, items, sizes, strict=True)])
            emissions = np.concatenate([hmm.head, hmm.others(voc, classes, counts, states)])
            times = np.bincount(np.concatenate(places), minlength=len(emissions))[head:]
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            n_known = batch.column(4).to_numpy() + np.bincount(owner, times * (counts > 0), batch.num_rows).astype(np.int64)
            base = batch.column(5).to_numpy() + np.bincount(owner, times * np.log10(counts + 0.5), batch.num_rows)
            score = np.zeros(batch.num_rows)
            for own, items, running in side_by_side(places):
                _, log_sum = forward(emissions[items], running, hmm.start, hmm.move)
                score[own] = log_sum / math.log(10)
            made = [pa.array(n_known), pa.array(base), pa.array(score)]
            yield pa.record_batch([*batch.columns[:4], *made], names=[*kept, "n_known", "base_score", "score"])

    by_text = others.groupBy("row_id").agg(F.collect_list(F.struct(F.col("pos"), F.col("n"), F.col("shares"))).alias("found"))
    texts = encoded.select(*kept, "n_known", "base", "classes", "rest").join(by_text, "row_id", "left")
    return texts.mapInArrow(run, schema)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: HmmSettings = HmmSettings()) -> DataFrame:
    """Learn from the documents that are not held out, and score all."""
    doc_id = column(docs, key)
    held_out = id_remainder(doc_id, 5) == 1
    counts = stored(count_words(docs.filter(~held_out).select(column(docs, text)), settings), "word-counts", CODEC)
    vocabulary = read_vocabulary(counts, settings)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), doc_id.cast("long").alias("doc_id"), held_out.alias("held_out"), column(docs, text).alias("text")
    )
    encoded = stored(encode_texts(rows, vocabulary), "encoded", CODEC)
    tied = train(encoded, vocabulary)
    expected = stored(expected_counts(encoded, tied, vocabulary), "expected", CODEC)
    others = stored(other_words(expected, settings.states), "other-words")
    scored = word_scores(encoded, others, untie(expected, others, tied, vocabulary), vocabulary)
    tokens = F.lit(vocabulary.total).cast("long").alias("train_tokens")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", tokens, "base_score", "score")
