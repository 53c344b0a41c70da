"""WARC archives, one gzip member a record: a writer, and a reader that splits files.

Reading: a task has a byte range of a file. It looks for gzip magic, takes a place for a member if
what it decodes to begins like a WARC record, and owns the records that start inside its range, the last of
which it follows beyond the range's end. Members then follow each other, so decoding each gives the
next start; the search goes on only where something else lies between. Every record is owned by one range.

Files are opened by tasks, so they lie in storage that pyarrow reaches from every executor. The writer's
files count only with the manifest that Spark commits: those of failed or repeated attempts are not in it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import materialize, new_path

_MAGIC = b"\x1f\x8b\x08"
_WINDOW = 1 << 20
_FILE_BYTES = 1 << 30
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD_ID = "urn:page:"
MANIFEST = "path string, size long, records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    local = re.match(r"file:(?://(?=/))?(/[^/].*)", path)
    return (pafs.LocalFileSystem(), local[1]) if local else pafs.FileSystem.from_uri(path)


def _header_value(text: str | None) -> str:
    """A value on one line: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str, revisit: bool) -> bytes:
    """One record. A revisit has the response's HTTP header, which tells the payload's size, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    names = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_RECORD_ID}{'none' if page_id is None else page_id}>"),
        ("WARC-Target-URI", _header_value(url)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if revisit:
        names += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_RECORD_ID}{refers_to}>")]
    names += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in names) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """page_id, url, payload size, SHA-1, type and refers_to of a record; a response's payload is measured, a revisit's is as its headers say."""
    head, _, rest = data.partition(b"\r\n\r\n")
    names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(names["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")

    def page(value: str | None) -> int | None:
        tail = (value or "").strip("<>").removeprefix(_RECORD_ID)
        return int(tail) if re.fullmatch(r"-?\d+", tail) else None

    if names["WARC-Type"] == "revisit":
        size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
        digest = base64.b32decode(names["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return page(names["WARC-Record-ID"]), names["WARC-Target-URI"], size, digest, names["WARC-Type"], page(names.get("WARC-Refers-To"))


class _Bytes:
    """Positioned reads of an open file."""

    def __init__(self, handle):
        self.handle = handle

    def at(self, offset: int, n: int = _WINDOW) -> bytes:
        self.handle.seek(offset)
        return self.handle.read(n)


def _begins_record(data: _Bytes, offset: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data.at(offset, 4096), 7) == b"WARC/1."
    except zlib.error:
        return False


def _member(data: _Bytes, offset: int) -> tuple[bytes, int]:
    """The decoded member at offset, and where it ends."""
    decoder, parts, at = zlib.decompressobj(31), [], offset
    while not decoder.eof:
        got = data.at(at)
        if not got:
            raise ValueError(f"a record at {offset} is cut off")
        parts.append(decoder.decompress(got))
        at += len(got)
    return b"".join(parts), at - len(decoder.unused_data)


def records_in_range(handle, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and decoded bytes of the records that start in [start, end). Damage inside a record raises an error."""
    data, at = _Bytes(handle), start
    while at < end:
        window = data.at(at, min(_WINDOW, end - at) + len(_MAGIC) - 1)
        found = window.find(_MAGIC)
        if found < 0:
            at += max(1, len(window) - len(_MAGIC) + 1)
            if not window:
                return
            continue
        at += found
        if not _begins_record(data, at):
            at += 1
            continue
        while at < end and _begins_record(data, at):
            member, after = _member(data, at)
            yield at, member
            at = after


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 6, least_revisit: int = 1000) -> DataFrame:
    """Writes a record per row of `pages` (page_id, url, html) to new files in `folder`; the committed manifest (path, size, records).

    Payload: html in UTF-8, null as empty. Of equal payloads of `least_revisit` bytes or more the
    rows with the largest page_id are responses and all others revisit it; a null page_id is the smallest. Payloads
    are compared by SHA-1 and counted per digest before the join, so only texts that repeat at all find a partner.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("size")
    )
    repeated = (
        rows.filter(F.col("size") >= least_revisit).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
        .filter("n > 1 AND target IS NOT NULL").select("digest", "target")
    )
    known = rows.join(repeated, "digest", "left")
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    ready = known.withColumn("revisit", revisit).withColumn("html", F.when(revisit, "").otherwise(F.col("html")).cast("binary"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open_fs(folder)
        files.create_dir(base)
        done, sink, name, n, size = [], None, "", 0, 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "size", "target", "revisit"))):
                if sink is None:
                    name, n, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = files.open_output_stream(f"{base}/{name}", compression=None, buffer_size=_WINDOW)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(*r[:6], date, r[6])) + packer.flush()
                sink.write(member)
                n, size = n + 1, size + len(member)
                if size >= _FILE_BYTES:
                    sink.close()
                    done.append((f"{folder}/{name}", size, n))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((f"{folder}/{name}", size, n))
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["path", "size", "records"])

    return materialize(ready.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(files: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """One row per record of `files` (path, size), read in ranges of `split_bytes`, each in a task of its own (up to 100,000 tasks)."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))
    ranges = files.filter("size > 0").select("path", "size", F.explode(starts).alias("start"))
    n = files.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    dealt = ranges.repartition(max(1, min(int(n), 100_000)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64())])
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start"))):
                store, name = _open_fs(path)
                with store.open_input_file(name) as handle:
                    for offset, data in records_in_range(handle, start, min(size, start + split_bytes)):
                        rows.append((*parse(data), path, offset))
                        if len(rows) >= 2000:
                            yield packed()
                            rows.clear()
        if rows:
            yield packed()

    return dealt.mapInArrow(read, RECORDS)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """path and size of the files at `path` (a glob or folder), without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


def round_trip(pages: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """Writes `pages` to archives in the shared folder and reads them back.

    Null and empty html: a response without payload. Repeated rows give a record each; urls come back
    percent-encoded where they held control characters or spaces. Columns beside page_id, url and html are not read.
    """
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), split_bytes)
