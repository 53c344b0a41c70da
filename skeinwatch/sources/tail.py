"""Log files followed by byte: a data source whose position is (file, byte), the same in batch and in a stream.

A file is known by its inode and its first line, so it keeps its place when rotation renames it, and a new file that takes
its name or inode starts anew. A stream's position stands after the last whole line, so a line that is still being
written waits for its end. Files are split into ranges of bytes; a range owns the lines that start in it. `seq`
comes from file and byte: it rises along a file, differs for equal lines, and is the same whenever and however the line is read.

The folder must be one that the driver and all executors see at the same path.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "followed_lines"
_SCHEMA = "value string, seq long, file string, byte long"
_BYTE_BITS, _FILE_BITS = 40, 21  # files below 1 TiB; three logs' numbers still fit a long
_BATCH_LINES, _BATCH_BYTES = 8192, 4 << 20
_BACK = 1 << 16


@dataclass
class ByteRange(InputPartition):
    path: str
    file: str
    start: int
    end: int


def identity(path: str) -> str | None:
    """Inode and checksum of the first line (of 256 bytes of it); none as long as it has no whole line."""
    with open(path, "rb") as f:
        inode, head = os.fstat(f.fileno()).st_ino, f.readline(1 << 20)
    if not head.endswith(b"\n") and len(head) < 1 << 20:
        return None
    return f"{inode:x}-{zlib.crc32(head[:256]):08x}"


def last_line_end(path: str) -> int:
    """Where the last whole line ends, read backwards from the end of the file."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            begin = max(0, at - _BACK)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


def _listed(folder: str, pattern: str) -> list[str]:
    """Files of the folder in the order of their names, hidden and marker files left out."""
    with os.scandir(folder) as entries:
        names = sorted(e.name for e in entries if e.is_file() and e.name[0] not in "._" and fnmatch(e.name, pattern))
    return [os.path.join(folder, n) for n in names]


def _ranges(path: str, file: str, start: int, end: int, size: int) -> list[ByteRange]:
    return [ByteRange(path, file, at, min(at + size, end)) for at in range(start, end, size)]


def _located(part: ByteRange, folder: str, pattern: str) -> str:
    """The file's path now: it may have been renamed since the range was planned."""
    for path in [part.path, *_listed(folder, pattern)]:
        try:
            if (identity(path) or part.file) == part.file:
                return path
        except FileNotFoundError:
            continue
    raise FileNotFoundError(f"{part.path} ({part.file}) is no longer in {folder}")


def _lines(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The lines that start in [start, end), with their first byte."""
    with open(path, "rb") as f:
        if start:
            f.seek(start - 1)
            f.readline()  # a line that started before, or just the end of the one before
        at = f.tell()
        while at < end and (line := f.readline()):
            yield at, line
            at += len(line)


class _Reading:
    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"].removeprefix("file://").removeprefix("file:"), options.get("pattern", "*")
        if ":/" in self.folder:
            raise ValueError(f"{self.folder}: lines are followed in a mounted folder only")
        self.split = int(options.get("split_bytes", 128 << 20))

    def read(self, part: ByteRange):
        import pyarrow as pa

        number = (zlib.crc32(part.file.encode()) & ((1 << _FILE_BITS) - 1)) << _BYTE_BITS
        schema = pa.schema([("value", pa.string()), ("seq", pa.int64()), ("file", pa.string()), ("byte", pa.int64())])

        def batch(values: list[str], at: list[int]):
            return pa.RecordBatch.from_arrays(
                [pa.array(values, pa.string()), pa.array([number + b for b in at], pa.int64()), pa.array([part.file] * len(at), pa.string()), pa.array(at, pa.int64())],
                schema=schema,
            )

        values, at, held = [], [], 0
        for byte, line in _lines(_located(part, self.folder, self.pattern), part.start, part.end):
            values.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
            at.append(byte)
            held += len(line)
            if len(at) >= _BATCH_LINES or held >= _BATCH_BYTES:
                yield batch(values, at)
                values, at, held = [], [], 0
        if at:
            yield batch(values, at)


class LineReader(_Reading, DataSourceReader):
    """All lines there are, a last one without its end included."""

    def partitions(self) -> list[ByteRange]:
        out = []
        for path in _listed(self.folder, self.pattern):
            if size := os.path.getsize(path):
                out += _ranges(path, identity(path) or f"{os.stat(path).st_ino:x}-", 0, size, self.split)
        return out or [ByteRange("", "", 0, 0)]

    def read(self, part: ByteRange):
        if part.end:
            yield from super().read(part)


class LineStreamReader(_Reading, DataSourceStreamReader):
    """Whole lines since the last position: {file: [path, byte]}. Files that left the folder leave the position too."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        at = {}
        for path in _listed(self.folder, self.pattern):
            try:
                if file := identity(path):
                    at[file] = [path, last_line_end(path)]
            except FileNotFoundError:  # renamed or removed since it was listed: the next look finds it
                continue
        return at

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        out = []
        for file, (path, to) in end.items():
            since = start.get(file, [path, 0])[1]
            out += _ranges(path, file, since if since <= to else 0, to, self.split)  # cut short and written anew: from its start
        return out


class FollowedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> LineStreamReader:
        return LineStreamReader(self.options)


def _reader(spark: SparkSession, reader, path: str, pattern: str, split_bytes: int):
    spark.dataSource.register(FollowedLines)
    return reader.format(NAME).option("path", path).option("pattern", pattern).option("split_bytes", split_bytes)


def scan_lines(spark: SparkSession, path: str, pattern: str = "*", split_bytes: int = 128 << 20) -> DataFrame:
    """The lines of a folder's files (value, seq, file, byte), in ranges of `split_bytes`."""
    return _reader(spark, spark.read, path, pattern, split_bytes).load()


def follow_lines(spark: SparkSession, path: str, pattern: str = "*", split_bytes: int = 128 << 20) -> DataFrame:
    """The same lines as a stream, growing and rotated files included.

    A rotated file must keep a name that `pattern` fits until the next batch, or what was added last is not read.
    """
    return _reader(spark, spark.readStream, path, pattern, split_bytes).load()
