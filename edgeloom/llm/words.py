"""Encoding by distinct segments: a text is cut where no token can cross, and each distinct segment is encoded once.

Prose repeats its words, so a library's encoder runs on few segments and the rest are look-ups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


class SegmentCache:
    """Ids of segments, as little-endian 32-bit numbers. A cache of `limit` segments starts anew, so memory is bounded."""

    def __init__(self, encode_batch: Callable[[list[str]], list[bytes]], limit: int = 900_000):
        self.encode_batch, self.limit = encode_batch, limit
        self.known: dict[str, bytes] = {}

    def encode(self, segments: list[str]) -> bytes:
        return b"".join(self.pieces(segments))

    def pieces(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment."""
        try:
            return list(map(self.known.__getitem__, segments))
        except KeyError:
            self.learn([segments])
            return list(map(self.known.__getitem__, segments))

    def learn(self, texts: list[list[str]]) -> None:
        """Encode what is new in some segmented texts, in one batch."""
        if len(self.known) > self.limit:
            self.known.clear()
        new = list(set().union(*texts).difference(self.known))
        if new:
            self.known.update(zip(new, self.encode_batch(new), strict=True))


#: A Python worker serves many tasks: what it has learnt is kept by the definition of the encoder.
_KEPT: dict[int, object] = {}


def kept(definition: str | bytes, make: Callable[[], object]) -> object:
    """The encoder of this definition in this process; another one takes its place."""
    key = hash(definition)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def as_uint32(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u4")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in small parts: only so many rows become Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_groups(texts: list, size: int = 64):
    for i in range(0, len(texts), size):
        yield texts[i : i + size]
