"""Lines of text files with their place: the file, the byte at which a line starts, and when the file was last written.

Spark's text source gives neither place nor order, and as a stream it reads a file once and for all. This source, written
with Spark's own Python data source interface, cuts files into byte ranges that tasks read, many small ones each, and as a stream it
goes on where it stopped in each file, so appended lines arrive. A line counts once it has ended with a line feed; as a
batch, the rest of a file counts too. Files are opened through Arrow's file systems: shared mounts and object stores.

A stream's offset has one number per file it follows, and its text goes through the driver, so a folder that is followed is
one of logs that are rotated away.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, line string, written_at timestamp_ntz"
CHUNK = 1 << 16
FILES, LEAST = 256, 1 << 20  # a task reads up to so many ranges, and bytes where ranges are smaller than that


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range:
    """Lines that start from byte `start` up to `stop` of a file."""

    path: str
    file: str
    start: int
    stop: int
    written_at: dt.datetime


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    parts: list[Range]


def _files(path: str) -> list:
    """Files below a folder with their sizes, hidden ones aside, in the order of their names."""
    from pyarrow import fs

    system, root = _open(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    shown = [f for f in found if f.is_file and not any(part[:1] in "._" for part in f.path[len(root) :].strip("/").split("/"))]
    return sorted(shown, key=lambda f: f.path)


def _cut(path: str, info, start: int, stop: int, size: int) -> list[Range]:
    written = (info.mtime or dt.datetime(1970, 1, 1)).replace(tzinfo=None)
    return [Range(path, info.path, a, min(a + size, stop), written) for a in range(start, stop, size)]


def _last_line_end(system, file: str, start: int, stop: int) -> int:
    """The byte after the last line feed between two places of a file; `start` if there is none."""
    with system.open_input_file(file) as f:
        while stop > start:
            at = max(start, stop - CHUNK)
            f.seek(at)
            feed = f.read(stop - at).rfind(b"\n")
            if feed >= 0:
                return at + feed + 1
            stop = at
    return start


def _lines(part: Range) -> Iterator[tuple]:
    system, _ = _open(part.path)
    with system.open_input_file(part.file) as raw:
        at = part.start
        if at:
            raw.seek(at - 1)
            rest = raw.read(1) != b"\n"  # a line that began before the range is read with the range it began in
        else:
            rest = False
        pending, begin = b"", at
        while True:
            chunk = raw.read(CHUNK)
            pending += chunk
            *lines, pending = pending.split(b"\n")
            if not chunk:
                lines, pending = ([pending] if pending else []), b""
            for line in lines:
                if not rest:
                    if begin >= part.stop:
                        return
                    yield (part.file, begin, line.removesuffix(b"\r").decode("utf-8", "replace"), part.written_at)
                rest = False
                begin += len(line) + 1
            if not chunk:
                return


def _packed(ranges: Iterable[Range], size: int) -> list[Ranges]:
    """Ranges for tasks, in turn: files are often far smaller than a range, so a task takes ranges up to `FILES` of them or to
    `size` bytes. Spark asks for one part at least: an empty one where there is nothing to read."""
    tasks: list[Ranges] = []
    room = 0
    for r in ranges:
        if not tasks or len(tasks[-1].parts) >= FILES or room < r.stop - r.start:
            tasks.append(Ranges([]))
            room = max(size, LEAST)
        tasks[-1].parts.append(r)
        room -= r.stop - r.start
    return tasks or [Ranges([])]


def read_range(partition: Ranges) -> Iterator[tuple]:
    """The lines of a task's ranges, in turn."""
    for part in partition.parts:
        yield from _lines(part)


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        return _packed((r for f in _files(self.path) for r in _cut(self.path, f, 0, f.size, self.size)), self.size)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        return read_range(partition)


class _StreamReader(DataSourceStreamReader):
    """The offset is, for each file, the byte after its last whole line."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system, _ = _open(self.path)
        ends = {f.path: _last_line_end(system, f.path, 0, f.size) for f in _files(self.path)}
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        infos = {f.path: f for f in _files(self.path)}
        named = ((infos[name], before.get(name, 0), stop) for name, stop in after.items() if name in infos)
        return _packed((r for info, start, stop in named for r in _cut(self.path, info, start, stop, self.size)), self.size)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        return read_range(partition)


class PlacedLines(DataSource):
    """Format `placed_lines`; options: path, range_bytes (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "placed_lines"

    def schema(self) -> str:
        return SCHEMA

    def _size(self) -> int:
        return int(self.options.get("range_bytes", 64 << 20))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._size())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self._size())
