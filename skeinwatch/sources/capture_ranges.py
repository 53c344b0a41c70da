"""Large classic captures read in byte ranges by many tasks.

A record has no mark, so a range first guesses where its first record starts: at the first byte from which three plausible
record headers follow one another. The guess is then proved: the chain of headers of the range before must end exactly there.
Where it does not, the range is walked again from where that chain ends, until no start moves. So the packets are those of a reader
that starts at the first byte, whatever the payloads hold. A record belongs to the range in which it starts.

The folder must be one that all executors see at the same path; `captures.scan_captures` reads any file system, a file in one task.
"""

from __future__ import annotations

import os
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skeinwatch import schemas as S
from skeinwatch.sources import captures as cap
from skeinwatch.sources.work import materialize

_RANGE = "path string, start long, end long, first long, exit long"
_UNKNOWN, _ENDED = -2, -1  # no plausible record found; the file's last whole record lies before
_HEAD, _RECORD = 24, 16
_LIMIT = 1 << 18  # bytes stored of a plausible record
_CHAIN = 3


class _File:
    """A capture's header, and its records from a given byte on."""

    def __init__(self, path: str):
        self.f = open(path, "rb")
        self.size = os.fstat(self.f.fileno()).st_size
        head = self.f.read(_HEAD)
        endian, self.per_us = cap.MAGIC[head[:4].hex().upper()]
        self.header = struct.Struct(endian + "IIII")

    def __enter__(self):
        return self

    def __exit__(self, *error):
        self.f.close()

    def at(self, pos: int) -> tuple[int, int, int, int] | None:
        """The header at `pos` of a record that is whole."""
        self.f.seek(pos)
        head = self.f.read(_RECORD)
        if len(head) < _RECORD:
            return None
        fields = self.header.unpack(head)
        return fields if pos + _RECORD + fields[2] <= self.size else None

    def guess(self, start: int, end: int) -> int:
        self.f.seek(start)
        near = self.f.read(min(end - start, 2 * _LIMIT) + _RECORD)
        for i in range(max(0, min(end - start, len(near) - _RECORD + 1))):
            if self._plausible(self.header.unpack_from(near, i)) and self._chain(start + i):
                return start + i
        return _UNKNOWN

    def _plausible(self, fields) -> bool:
        sec, frac, stored, wire = fields
        return 0 < stored <= min(wire, _LIMIT) and frac < 1000000 * self.per_us and sec > 0

    def _chain(self, pos: int) -> bool:
        for _ in range(_CHAIN):
            if pos == self.size:
                return True
            fields = self.at(pos)
            if fields is None or not self._plausible(fields):
                return False
            pos += _RECORD + fields[2]
        return True

    def walk(self, first: int, end: int) -> int:
        """Where the first record at or after `end` starts, following headers from `first`."""
        while 0 <= first < end:
            fields = self.at(first)
            if fields is None:
                return _ENDED
            first += _RECORD + fields[2]
        return first


def _walked(batches):
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            with _File(r.path) as f:
                first = (_HEAD if r.start == 0 else f.guess(r.start, r.end)) if pd.isna(r.first) else int(r.first)
                rows.append((r.path, r.start, r.end, first, f.walk(first, r.end)))
        yield pd.DataFrame(rows, columns=["path", "start", "end", "first", "exit"])


def record_ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """Ranges of the files (path, length) with the byte of the first record of each (-1: none any more)."""
    slots = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))).alias("start")
    cut = files.filter(F.col("length") > _HEAD).select("path", "length", starts)
    cut = cut.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"), F.lit(None).cast("long").alias("first"))
    cut = cut.repartition(slots, "path", "start")
    ranges = materialize(cut.mapInPandas(_walked, _RANGE), "capture-ranges")
    along = Window.partitionBy("path").orderBy("start")  # one short row a range
    while True:
        handed = F.when(F.col("start") == 0, F.col("first")).otherwise(F.lag("exit").over(along))
        # an unknown exit says nothing yet: the range before it is walked first
        proved = ranges.withColumn("_true", F.when(handed == _UNKNOWN, F.col("first")).otherwise(handed))
        moved = proved.filter("_true <> first").select("path", "start", "end", F.col("_true").alias("first"))
        if moved.isEmpty():
            return ranges
        again = moved.repartition(slots, "path", "start").mapInPandas(_walked, _RANGE)
        kept = proved.filter("_true = first").drop("_true")
        ranges = materialize(kept.unionByName(again), "capture-ranges")


def _decoded(batches):
    for pdf in batches:
        for r in pdf.itertuples():
            rows, name, pos = [], r.path.rsplit("/", 1)[-1], int(r.first)
            with _File(r.path) as f:
                while 0 <= pos < r.end and (fields := f.at(pos)):
                    sec, frac, stored, wire = fields
                    found = cap._decode_frame(f.f.read(stored))
                    if found is not None:
                        rows.append((name, pos, sec * 1000000 + frac // f.per_us, *found[:6], wire, *found[6:]))
                    pos += _RECORD + stored
                    if len(rows) == cap.ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=cap._COLUMNS)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=cap._COLUMNS)


def scan_large_captures(spark: SparkSession, directory: str, range_bytes: int = 64 << 20) -> DataFrame:
    """Packets of all captures of a folder, classic ones by ranges, those made of blocks a file in one task.

    `seq` is the byte at which a packet's record starts (its number in the file for those made of blocks): it orders the packets of a file.
    """
    local = F.regexp_replace("path", "^file:/+", "/")
    files = spark.read.format("binaryFile").load(directory)
    known = files.filter(cap.extension(F.col("path")).isin(cap.EXTENSIONS)).select("path", "length")
    heads = materialize(known.select(local.alias("path"), "length").mapInPandas(_with_magic, "path string, length long, magic string"), "captures")
    ranges = record_ranges(heads.filter(F.col("magic").isin(list(cap.MAGIC))).select("path", "length"), range_bytes)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = ranges.filter("first >= 0 AND first < end").repartition(slots, "path", "start").mapInPandas(_decoded, S.PACKET)
    blocks = heads.filter(F.col("magic") == cap.MAGIC_NG).mapInPandas(_whole, S.PACKET)
    return found.unionByName(blocks)


def _with_magic(batches):
    for pdf in batches:
        magic = []
        for path in pdf["path"]:
            with open(path, "rb") as f:
                magic.append(f.read(4).hex().upper())
        yield pdf.assign(magic=magic)


def _whole(batches):
    for pdf in batches:
        for path in pdf["path"]:
            with open(path, "rb") as f:
                yield from cap._decode_files([pd.DataFrame({"file": [path.rsplit("/", 1)[-1]], "content": [f.read()]})])
