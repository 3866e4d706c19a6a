"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read field by field (protocol buffer wire format). Its pieces, scores, types, normaliser and trainer
settings are rebuilt as a tokenizers pipeline: character map, space to metaspace, unigram scores or byte-pair merges,
byte fallback. Batches of distinct segments are encoded by the library, which uses its own threads.

A text is cut before each run of metaspaces that follows another character. No piece of the model may hold a metaspace
after another character (checked on loading), so no piece crosses such a cut and the ids are those of the whole text;
a byte-pair model with other pieces, and any unigram model, is encoded text by text. The library's unigram model takes
a text that spells out the name of a byte piece for that piece; parity is false there.

Decoding goes by distinct segments as well: the ids of a text are those of its segments in turn, and so is its text.

Parity: each distinct segment that a worker meets is encoded by the SentencePiece library as well, and `parity` says
whether all segments of a text agree. Round trip: `decoded` is the text from the ids.

Defined results: null text gives null ids and decoded text, parity true; empty text gives no ids and an empty text;
repeated rows are encoded each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from edgeloom.llm.common import column
from edgeloom.llm.words import SegmentCache, as_uint32, in_groups, kept, sliced

SPACE = "▁"
# Fixed values of the model file: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "\U0010ffff\n\U0010ffff"  # parts texts that are decoded together

# Spaces at the end of a text stay with its last word: on their own they can't be given to the other library.
_SEGMENT = re.compile(rf"{SPACE}*[^{SPACE}]+(?:{SPACE}+\Z)?|{SPACE}+")


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of one protocol buffer message; nested messages stay bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is not used by model files")
        yield tag >> 3, value


@dataclass
class SentencePieceModel:
    """What a model file states. The defaults are those of the file format."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> SentencePieceModel:
        model = cls()
        for number, value in wire_fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in wire_fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                model.pieces.append(piece)
                model.scores.append(score)
                model.types.append(kind)
            elif number == 2:
                for n, v in wire_fields(value):
                    if n == 3:
                        model.model_type = v
                    elif n == 35:
                        model.byte_fallback = bool(v)
                    elif n == 40:
                        model.unk_id = v
            elif number == 3:
                for n, v in wire_fields(value):
                    if n == 2:
                        model.charsmap = v
                    elif n == 3:
                        model.add_dummy_prefix = bool(v)
                    elif n == 4:
                        model.remove_extra_whitespaces = bool(v)
                    elif n == 5:
                        model.escape_whitespaces = bool(v)
        return model

    def merges(self) -> list[tuple[str, str]]:
        """Byte-pair merges: every split of a piece into two pieces, better pieces first.

        The library joins the neighbours whose joined piece scores best, so the order of a merge is that of its result.
        """
        usable = {p for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER_DEFINED, UNUSED)}
        order = sorted((i for i, t in enumerate(self.types) if t == NORMAL), key=lambda i: (-self.scores[i], i))
        return [
            (p[:k], p[k:]) for p in (self.pieces[i] for i in order) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable
        ]

    def cuts_at_spaces(self) -> bool:
        return self.model_type == BPE and not any(SPACE in p.lstrip(SPACE) for p in self.pieces)


class Codec:
    """A SentencePiece model on the tokenizers library, with the SentencePiece library beside it for parity."""

    def __init__(self, model_bytes: bytes):
        import sentencepiece
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        self.model = m = SentencePieceModel.parse(model_bytes)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        if m.model_type == UNIGRAM:
            # Control pieces never stand for text: their names get a mark that no text should hold.
            names = [p if t not in (CONTROL, UNKNOWN) else "\U0010ffff" + p for p, t in zip(m.pieces, m.types, strict=True)]
            core = models.Unigram(list(zip(names, m.scores, strict=True)), m.unk_id, m.byte_fallback)
        elif m.model_type == BPE:
            vocabulary = {p: i for i, p in enumerate(m.pieces)}
            core = models.BPE(vocabulary, m.merges(), unk_token=m.pieces[m.unk_id], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            raise ValueError(f"model type {m.model_type} is not supported")
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.remove_extra_whitespaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        self.clean = normalizers.Sequence(steps)
        self.tokenizer = Tokenizer(core)
        self.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.by_segment = m.cuts_at_spaces()
        self.cache = SegmentCache(self._segments)
        self.odd: set[str] = set()
        self.texts: dict[bytes, str] = {}
        self.shown = {i for i, t in enumerate(m.types) if t != CONTROL}

    def normalize(self, text: str) -> str:
        """The text as the model sees it: cleaned, spaces as metaspaces, one in front."""
        text = self.clean.normalize_str(text)
        if text and self.model.add_dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.model.escape_whitespaces else text

    def _batch(self, segments: list[str]) -> list[list[int]]:
        """Encode segments with the library; remember those the SentencePiece library encodes otherwise."""
        made = [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        plain = [s[self.model.add_dummy_prefix :].replace(SPACE, " ") for s in segments] if self.by_segment else segments
        if self.by_segment:
            if len(self.odd) > self.cache.limit:
                self.odd.clear()
            theirs = self.other.encode(plain, num_threads=1)
            self.odd.update(s for s, a, b in zip(segments, made, theirs, strict=True) if a != b)
        return made

    def _segments(self, segments: list[str]) -> list[bytes]:
        """Encode segments, and decode their ids at once: `texts` has the text of all ids that the cache gives."""
        if not self.cache.known:
            self.texts.clear()
        made = self._batch(segments)
        packed = [struct.pack(f"<{len(ids)}I", *ids) for ids in made]
        self.texts.update(zip(packed, self._decode_each(made), strict=True))
        return packed

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[bytes, bool]]:
        """Ids of each text as little-endian 32-bit numbers, and whether both libraries agree on them."""
        return ((packed, parity) for packed, parity, _ in self.there_and_back(texts))

    def there_and_back(self, texts: list[str]) -> Iterator[tuple[bytes, bool, str]]:
        """The same, and the text that the ids decode to."""
        for group in in_groups(texts):
            ready = [self.normalize(t) for t in group]
            if self.by_segment:
                cut = [_SEGMENT.findall(t) for t in ready]
                self.cache.learn(cut)
                for segments in cut:
                    packed = self.cache.pieces(segments)
                    yield b"".join(packed), not self.odd or self.odd.isdisjoint(segments), self.decode_pieces(packed)
            else:
                for ids, theirs in zip(self._batch(ready), self.other.encode(group, num_threads=1), strict=True):
                    yield np.array(ids, dtype="<u4").tobytes(), ids == theirs, self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: bytes joined to characters, without control pieces and the space put in front."""
        return self._without_prefix(self._decode(ids))

    def decode_pieces(self, packed: list[bytes]) -> str:
        """The same for the ids of whole segments, whose texts are known. The bytes of a character never lie in two segments,
        so the text is that of all ids in one."""
        return self._without_prefix("".join(map(self.texts.__getitem__, packed)))

    def _pieces(self, ids: list[int]) -> list[str]:
        pieces = self.model.pieces
        return [pieces[i] for i in ids if i in self.shown]

    def _decode(self, ids: list[int]) -> str:
        return self.decoder.decode(self._pieces(ids))

    def _decode_each(self, many: list[list[int]]) -> list[str]:
        """The texts of runs of ids, decoded in one call with a mark after each; one by one if some text holds the mark."""
        pieces: list[str] = []
        for ids in many:
            pieces += self._pieces(ids)
            pieces.append(MARK)
        texts = self.decoder.decode(pieces).split(MARK)
        return texts[:-1] if len(texts) == len(many) + 1 else [self._decode(ids) for ids in many]

    def _without_prefix(self, text: str) -> str:
        return text[1:] if self.model.add_dummy_prefix and text.startswith(" ") else text


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_bytes: bytes, key: str = "doc_id", text: str = "text", outputs: bool = True) -> DataFrame:
    """Per document: n_ids, ids_crc32, parity, round_trip; with `outputs` also ids and the decoded text.

    The model's bytes go along with the tasks; a vocabulary does not grow with the data.
    """
    schema = "doc_id long, n_ids long, ids_crc32 long, parity boolean, round_trip boolean"
    schema += ", ids array<long>, decoded string" * outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(model_bytes, lambda: Codec(model_bytes))
        for batch in sliced(batches):
            doc_ids, texts = (batch.column(i).to_pylist() for i in range(2))
            out: list[list] = [[] for _ in range(5 + 2 * outputs)]
            encoded = codec.there_and_back([t or "" for t in texts])
            for doc_id, value, (packed, parity, decoded) in zip(doc_ids, texts, encoded, strict=True):
                if value is None:
                    row = [doc_id, None, None, True, True, None, None]
                else:
                    ids = as_uint32(packed)
                    row = [doc_id, len(ids), zlib.crc32(packed), parity, decoded == value, *([ids, decoded] if outputs else [])]
                for to, v in zip(out, row, strict=False):
                    to.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.string()]
            names = ["doc_id", "n_ids", "ids_crc32", "parity", "round_trip", "ids", "decoded"]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, types, strict=False)], names=names[: len(out)])

    return docs.select(column(docs, key).cast("long"), column(docs, text)).mapInArrow(run, schema)
