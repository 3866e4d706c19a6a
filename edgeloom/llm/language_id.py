"""Language of words and texts by a linear-chain conditional random field.

Each word has hashed features: prefixes, suffixes, character n-grams, and membership in lexicons learnt from the labelled
texts. Learned weights turn them into a score per language, learned transitions tie neighbours together, and
forward-backward gives the probability of each language at each word, also where a text switches between languages. The
language of a text is the one with the highest mean probability over its words, and that mean is its score.

The field is fitted on a bounded, seeded choice of different labelled training texts (`sample`, in equal parts per
language, of longer ones a stretch of `longest` characters); everything else reads whole texts. Training chains are made of stretches of words from
different texts, so switches are seen.

Defined results: null text and text without a letter are `und` with score 0, as is every text if no labelled training
text exists; with one known language all texts with letters get it; equal means go to the first language by name;
repeated rows are judged each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.chains import forward_backward, side_by_side
from edgeloom.llm.common import column, id_remainder, in_small_batches
from edgeloom.llm.words import kept, sliced

UNDETERMINED = "und"
SCORED_AT_ONCE = 10_000


@dataclass(frozen=True)
class CrfSettings:
    """`sample`: labelled texts the field is fitted on. `width`: hashed features."""

    sample: int = 1_000
    longest: int = 20_000
    width: int = 1 << 15
    rounds: int = 25
    rate: float = 0.3
    decay: float = 1e-4
    cache: int = 500_000
    seed: int = 3


def letters(word: str) -> str:
    """The word without what stands before its first and after its last letter; empty if it has none."""
    if word.isalpha():
        return word
    at = [i for i, c in enumerate(word) if c.isalpha()]
    return word[at[0] : at[-1] + 1] if at else ""


def word_features(word: str, width: int) -> list[int]:
    """Hashed affixes and character n-grams of a word of letters."""
    marked = f"<{word}>"
    names = [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3)]
    names += [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % width for n in names]


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # (width + one row per lexicon and one for words in none) x languages
    lexicons: dict[str, list[int]]  # word: languages whose lexicon has it
    start: np.ndarray
    move: np.ndarray
    settings: CrfSettings

    def features(self, word: str) -> list[int]:
        width, none = self.settings.width, len(self.languages)
        return word_features(word, width) + [width + k for k in self.lexicons.get(word, [none])]

    def score(self, words: list[str]) -> np.ndarray:
        """Score of each language for each distinct word."""
        return _scores(self.weights, *_flat([self.features(w) for w in words]))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists])
    return np.array([i for x in lists for i in x], dtype=np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes


def _scores(weights: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[flat], starts, axis=0) / np.sqrt(sizes)[:, None]


def _potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(scores - scores.max(axis=-1, keepdims=True), -60, 0))


def fit(texts: list[tuple[str, str]], settings: CrfSettings = CrfSettings()) -> Crf:
    """Fit the field on (text, language) pairs by gradient ascent on the likelihood of their labels."""
    languages = sorted({lang for _, lang in texts})
    n = len(languages)
    of = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(settings.seed)
    counts: list[Counter] = [Counter() for _ in languages]
    stretches = []
    for text, lang in texts:
        words = [w for w in map(letters, text.lower().split()) if w]
        counts[of[lang]].update(words)
        while words:
            cut = int(rng.integers(10, 60))
            stretches.append((words[:cut], of[lang]))
            words = words[cut:]
    lexicons: dict[str, list[int]] = {}
    for i, seen in enumerate(counts):
        for word, times in seen.items():
            if times > 1:
                lexicons.setdefault(word, []).append(i)
    crf = Crf(languages, np.zeros((settings.width + n + 1, n)), lexicons, np.full(n, 1 / max(n, 1)), np.ones((n, n)), settings)
    if n < 2:
        return crf

    number: dict[str, int] = {}
    chains, labels = [], []
    order = rng.permutation(len(stretches))
    for at in range(0, len(order), 6):
        part = [stretches[i] for i in order[at : at + 6]]
        chains.append(np.array([number.setdefault(w, len(number)) for words, _ in part for w in words]))
        labels.append(np.array([lang for words, lang in part for _ in words]))
    flat, starts, sizes = _flat([crf.features(w) for w in number])
    weight_of = np.repeat(1 / np.sqrt(sizes), sizes)
    total = sum(map(len, chains))
    groups = list(side_by_side(chains))
    told_words = np.zeros((len(number), n))
    told_moves = np.zeros((n, n))
    for c, y in zip(chains, labels, strict=True):
        np.add.at(told_words, (c, y), 1)
        np.add.at(told_moves, (y[:-1], y[1:]), 1)

    moves, weights = np.zeros((n, n)), crf.weights
    squares = [np.full(weights.shape, 1e-8), np.full(moves.shape, 1e-8)]
    for _ in range(settings.rounds):
        potential = _potentials(_scores(weights, flat, starts, sizes))
        seen_words, seen_moves = np.zeros_like(told_words), np.zeros_like(told_moves)
        for _, items, running in groups:
            gamma, expected, _ = forward_backward(potential[items], running, crf.start, np.exp(moves))
            seen_moves += expected
            for k in range(n):
                seen_words[:, k] += np.bincount(items.ravel(), gamma[:, :, k].ravel(), len(number))
        each = (told_words - seen_words) / total
        per_feature = np.repeat(each, sizes, axis=0) * weight_of[:, None]
        slope = np.stack([np.bincount(flat, per_feature[:, k], len(weights)) for k in range(n)], axis=1) - settings.decay * weights / total
        for value, grad, square in ((weights, slope, squares[0]), (moves, (told_moves - seen_moves) / total, squares[1])):
            square += grad**2
            value += settings.rate * grad / np.sqrt(square)
    crf.move = np.exp(moves - moves.max())
    return crf


class Tagger:
    """A field with the potentials of the words met so far; a full cache starts anew."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.clear()

    def clear(self) -> None:
        self.number = {"": 0}  # words without a letter: no language preferred
        self.potentials = np.ones((1024, len(self.crf.languages)))
        self.used = 1
        self.letters = np.zeros(1024, dtype=bool)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Words of each text as row numbers of `potentials`."""
        if len(self.number) > self.crf.settings.cache:
            self.clear()
        words = [t.lower().split() for t in texts]
        new = list(set().union(*words).difference(self.number))
        shapes = [letters(w) for w in new]
        some = list({s for s in shapes if s and s not in self.number})
        if some:
            need = self.used + len(some)
            if need > len(self.potentials):
                more = max(need, 2 * len(self.potentials)) - len(self.potentials)
                self.potentials = np.concatenate([self.potentials, np.ones((more, self.potentials.shape[1]))])
            for at in range(0, len(some), SCORED_AT_ONCE):  # features of a word take far more room than its scores
                part = some[at : at + SCORED_AT_ONCE]
                self.potentials[self.used + at : self.used + at + len(part)] = _potentials(self.crf.score(part))
            self.number.update(zip(some, range(self.used, need), strict=True))
            self.used = need
        self.number.update((w, self.number[s]) for w, s in zip(new, shapes, strict=True))
        get = self.number.__getitem__
        return [np.fromiter(map(get, w), dtype=np.int64, count=len(w)) for w in words]

    def posteriors(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place in the list, word numbers, words x languages) of each text that has words."""
        chains = self.numbers(texts)
        for own, items, running in side_by_side(chains):
            gamma, _, _ = forward_backward(self.potentials[items], running, self.crf.start, self.crf.move)
            for c, i in enumerate(own):
                yield i, chains[i], gamma[: len(chains[i]), c]


def spans_of(labels: np.ndarray, languages: list[str]) -> list[dict]:
    """Stretches of words of one language: first word, word after the last, language."""
    edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    return [{"start": a, "end": b, "lang": languages[labels[a]]} for a, b in zip(edges, edges[1:], strict=False)]


def labelled_sample(docs: DataFrame, text: str, lang: str, usable, settings: CrfSettings) -> list[tuple[str, str]]:
    """At most `sample` different labelled texts, in equal parts per language, first by a seeded hash of the text.

    Of texts over `longest` characters a stretch of that length is taken, from a place that the hash says.
    """
    texts = docs.filter(usable & column(docs, lang).isNotNull()).select(column(docs, text).alias("text"), column(docs, lang).alias("lang"))
    hashed = texts.filter(F.col("text").isNotNull()).withColumn("at", F.xxhash64(F.lit(settings.seed), "text"))
    different = hashed.select("lang", "at").distinct()
    languages = different.select("lang").distinct().count()
    if not languages:
        return []
    quota = max(1, settings.sample // languages)
    # The hashes are even, so below a limit there are about eight times the texts that are wanted, however many a language has.
    many = different.groupBy("lang").agg(F.count(F.lit(1)).alias("many"))
    low = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(8.0 * (quota + 8)) / F.col("many"))
    few = different.join(many, "lang").filter(F.col("at").cast("double") <= low).drop("many")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    ranked = few.withColumn("rank", rank).filter(F.col("rank") <= quota)
    chosen = ranked.orderBy("rank", "at").limit(settings.sample)
    # At most `sample` rows; the copies of a text meet in one.
    begin = F.pmod("at", F.greatest(F.length("text") - settings.longest, F.lit(0)) + 1).cast("int") + 1
    stretch = hashed.join(F.broadcast(chosen), ["lang", "at"]).withColumn("text", F.col("text").substr(begin, F.lit(settings.longest)))
    read = stretch.groupBy("lang", "rank").agg(F.min("text").alias("text"))
    return [(r.text, r.lang) for r in read.orderBy("lang", "rank").collect()]


def _tagging(docs: DataFrame, crf: Crf):
    """A function from texts to (language, score, labels of the words if they are asked for) each, for use in tasks."""
    definition = pickle.dumps(crf)
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # of fixed size: the field grows with its settings only

    def tag(texts: list[str | None], labels: bool = False) -> list[tuple[str, float, np.ndarray | None]]:
        tagger = kept(shared.value, lambda: Tagger(pickle.loads(shared.value)))
        out: list = [(UNDETERMINED, 0.0, None)] * len(texts)
        if not crf_languages:
            return out
        for i, words, gamma in tagger.posteriors([t or "" for t in texts]):
            own = gamma[words > 0]
            if len(own):
                mean = own.mean(axis=0)
                best = int(mean.argmax())
                # Probabilities of a text are a view of those of its whole group, which they would keep.
                out[i] = (crf_languages[best], min(1.0, float(mean[best])), gamma.argmax(axis=1) if labels else None)
        return out

    crf_languages = crf.languages
    return tag


def tag_documents(docs: DataFrame, crf: Crf, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """Language and score of each whole text; with `spans` also its stretches of one language."""
    tag, languages = _tagging(docs, crf), crf.languages
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<start: int, end: int, lang: string>>" * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            found = tag(batch.column(1).to_pylist(), spans)
            arrays = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                arrays.append(pa.array([[] if g is None else spans_of(g, languages) for _, _, g in found], kind))
                names.append("spans")
            yield pa.record_batch(arrays, names=names)

    return in_small_batches(docs.select(column(docs, key).cast("long"), column(docs, text))).mapInArrow(run, schema)


def accepted(docs: DataFrame, crf: Crf, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows, unchanged, whose text has a language with a score of at least `least`; with a letter, if no language is known."""
    tag, unknown = _tagging(docs, crf), not crf.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            texts = batch.column(text).to_pylist()
            if unknown:
                yield batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in texts], pa.bool_()))
                continue
            found = tag(texts)
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score, _ in found], pa.bool_()))

    return in_small_batches(docs).mapInArrow(run, docs.schema)


def fit_on_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", settings: CrfSettings = CrfSettings()) -> Crf:
    """Fit on a bounded choice of the documents that are not held out."""
    return fit(labelled_sample(docs, text, lang, ~held_out(docs, key), settings), settings)


def held_out(docs: DataFrame, key: str = "doc_id"):
    return id_remainder(column(docs, key), 4) == 2


def identify_languages(docs: DataFrame, settings: CrfSettings = CrfSettings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    tagged = tag_documents(docs, fit_on_documents(docs, settings=settings))
    return tagged.select("doc_id", held_out(tagged).alias("held_out"), "lang_pred", "score")
