"""Packing against whole-text encoding and simple bounds."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from edgeloom.llm.packing import ByteBpe, pack_documents, packing_plan, read_text_file, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a\x0bb  c", "  x \n\n y<|endoftext|>z", "it's　ok \t", "", "\n", " a", "x \x1c!y\x1c z", "e\u0301 don't,no  \r\n"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_segments_give_the_ids_of_whole_texts(tokenizer, words):
    rng = random.Random(1)
    texts = [*ODD, *["".join(rng.choice([*words[:30], " ", "  ", "\n", ".", "###", "'s", "12", " ", "\x1d", "é"]) for _ in range(40)) for _ in range(300)]]
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in ByteBpe(read_text_file(PATH)).encode_texts(texts)]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_valid_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 2048])
    counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, capacity + 1), min(capacity, 200))}
    taken, ranks = defaultdict(list), defaultdict(set)
    for length, rank, many, first, offset in packing_plan(counts, capacity):
        for k in range(many):
            taken[first + k].append((offset, length))
            assert rank + k not in ranks[length]
            ranks[length].add(rank + k)
    assert {n: len(r) for n, r in ranks.items()} == counts
    for parts in taken.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in parts) <= 2
    total = sum(n * c for n, c in counts.items())
    large = sum(c for n, c in counts.items() if 2 * n > capacity)
    assert len(taken) <= max(-(-total // capacity), large) * 1.1 + 2


def check(rows, texts, tokenizer, capacity):
    whole = defaultdict(list)
    for i, t in texts:
        whole[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, versions in whole.items():
        wanted = []
        for ids in versions:
            first = len(ids) % capacity or capacity
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            wanted += [(p, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]) == sorted(wanted)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_documents(documents, words, tokenizer):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 20, 60])))) for i in range(300)]
    texts += [(900, None), (901, ""), (None, "no id"), (902, "very long " * 3000), *[(903, "same text")] * 300]
    rows = pack_documents(documents(texts, extra="piece sequence_id offset rank"), PATH, capacity=100).collect()
    check(rows, texts, tokenizer, 100)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 100) * 1.05 + 1


def test_empty(documents):
    assert pack_documents(documents([]), PATH).collect() == []


def test_sequences_hold_the_ids(documents, tokenizer):
    packed = pack_documents(documents([(1, "one two"), (2, "three " * 50)]), PATH, capacity=40, keep_ids=True)
    made = [i for r in sequences(packed).collect() for i in r.ids]
    want = [i for t in ("one two", "three " * 50) for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 0]]
    assert sorted(made) == sorted(want)
