"""WARC archives: writing, normalising monolithic gzip, and reading by index.

Writers put many records into one gzip stream per file, the layout that can't
be read at an offset.  The normaliser inflates such a stream once, from start
to end, rewrites each record as a gzip member of its own, and writes a sidecar
index of offsets.  Readers then open members at the places the sidecar names.

Files are named anew by each attempt of a task, and only those named in the
manifest that Spark commits count; an executor lost midway leaves a file that
nobody reads.  A stream is handled in blocks, so memory holds one record at a
time.

Defined cases: a null payload is empty; of records with equal payloads the rows
with the smallest id are responses and the others revisits (``None`` as id is
larger than any, and rows without id whose payload no id has are responses);
an empty table makes archives without records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fresh_path, materialise, open_filesystem

BLOCK = 1 << 20
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, revisit_of: int | None) -> bytes:
    """One record; a revisit holds the HTTP head only."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit_of is not None else http + payload
    target = "".join(c for c in url or "" if c > " ")
    head = [
        ("WARC-Type", "response" if revisit_of is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{target}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit_of is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-ID", str(revisit_of))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _head_of(buffer: bytes | bytearray) -> tuple[dict[str, str], int] | None:
    """The named fields at the buffer's start, and where the block begins."""
    end = buffer.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = bytes(buffer[:end]).decode().split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError("not at the start of a record")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:]), end + 4


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, one at a time."""
    buffer, need = bytearray(), 0
    for chunk in chunks:
        buffer += chunk
        while True:
            if not need:
                head = _head_of(buffer)
                if head is None:
                    break
                need = head[1] + int(head[0]["Content-Length"]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = 0
    if buffer:
        raise ValueError("the archive ends within a record")


def inflate(source) -> Iterator[bytes]:
    """Inflated blocks of a gzip file of one or more members."""
    unzip = zlib.decompressobj(31)
    while data := source.read(BLOCK):
        while data:
            yield unzip.decompress(data, 4 * BLOCK)
            data = unzip.unconsumed_tail
            if unzip.eof:
                data = unzip.unused_data
                unzip = zlib.decompressobj(31)
    yield unzip.flush()


def read_record(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, digest, type, refers_to) of one member.

    A response's length and digest come from its payload and must agree with
    its head.
    """
    record = zlib.decompress(member, 31)
    head, at = _head_of(record)
    block = record[at : at + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError("payload and head of a record disagree")
    number = lambda x: int(x) if x else None
    return number(head["X-Page-ID"]), length, digest, head["WARC-Type"], number(head.get("X-Refers-To-Page-ID"))


def first_of_equals(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(digest, first_id) of every payload that occurs more than once.

    Partial aggregation sends one row per payload and task, whatever the number
    of copies.
    """
    digest = F.sha1(F.coalesce(F.col(payload_col), F.lit("")).cast("binary"))
    copies = pages.groupBy(digest.alias("digest")).agg(F.min(F.col(id_col).cast("long")).alias("first_id"), F.count(F.lit(1)).alias("n"))
    return copies.filter("n > 1 and first_id is not null").select("digest", "first_id")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", level: int = 4) -> DataFrame:
    """Write one monolithic archive per partition; (path, records) of each.

    Payloads move only if the list of repeated ones is too long to broadcast.
    """
    firsts = materialise(first_of_equals(pages, id_col, payload_col), "warc-firsts")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")
    ).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    first = F.col("first_id")
    revisit = F.when(F.col("page_id").isNull() | (F.col("page_id") > first), first)
    known = rows.join(firsts, "digest", "left").select("page_id", "url", "payload", revisit.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        system, base = open_filesystem(folder)
        system.create_dir(base, recursive=True)
        name, count, pack = f"{uuid.uuid4().hex}.warc.gz", 0, zlib.compressobj(level, zlib.DEFLATED, 31)
        with system.open_output_stream(f"{base}/{name}", compression=None) as out:
            while batch is not None:
                for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(pack.compress(record_bytes(page, url, payload.encode(), refers)))
                    count += 1
                batch = next(batches, None)
            out.write(pack.flush())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["path", "records"])

    return materialise(known.mapInArrow(write, "path string, records long"), "warc-manifest")


def normalise(archives: DataFrame, source: str, folder: str, level: int = 4) -> DataFrame:
    """Rewrite monolithic archives with a member per record; (path, records) of each.

    Beside each archive a sidecar ``<path>.idx`` has a line with offset and
    length of each member.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            system, base = open_filesystem(folder)
            _, old = open_filesystem(source)
            system.create_dir(base, recursive=True)
            for path in batch.column(0).to_pylist():
                name, at, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with (
                    system.open_input_stream(f"{old}/{path}", compression=None) as data,
                    system.open_output_stream(f"{base}/{name}", compression=None) as out,
                    system.open_output_stream(f"{base}/{name}.idx", compression=None) as sidecar,
                ):
                    for record in split_records(inflate(data)):
                        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = pack.compress(record) + pack.flush()
                        out.write(member)
                        sidecar.write(f"{at} {len(member)}\n".encode())
                        at, count = at + len(member), count + 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["path", "records"])

    # A task per archive: a stream can only be inflated from its start.
    each = archives.select("path").repartition(max(1, archives.count()), "path")
    return materialise(each.mapInArrow(rewrite, "path string, records long"), "warc-normal")


_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _sidecar_lines(data) -> Iterator[tuple[int, int]]:
    """(offset, length) of each line of a sidecar, read in blocks."""
    rest = b""
    while block := data.read(BLOCK):
        *lines, rest = (rest + block).split(b"\n")
        for line in lines:
            offset, length = line.split(b" ")
            yield int(offset), int(length)


def read_archives(archives: DataFrame, folder: str, rows: int = 1024) -> DataFrame:
    """Every record of the archives (path, records), read at its place in the sidecar: see ``read_record``."""

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in _RECORDS.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_filesystem(folder)
        for batch in batches:
            for path, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, count = [], 0
                with system.open_input_file(f"{base}/{path}") as source, system.open_input_stream(f"{base}/{path}.idx", compression=None) as sidecar:
                    for offset, length in _sidecar_lines(sidecar):
                        source.seek(offset)
                        found.append(read_record(source.read(length)))
                        if len(found) == rows:
                            yield batch_of(found)
                            found, count = [], count + rows
                if count + len(found) != records:
                    raise ValueError(f"{path} has {count + len(found)} of {records} records")
                yield batch_of(found)

    each = archives.select("path", "records").repartition(max(1, archives.count()), "path")
    return each.mapInArrow(read, _RECORDS)


def archive_pages(pages: DataFrame, **columns) -> DataFrame:
    """Write, normalise and read back all pages; one row per record."""
    spark: SparkSession = pages.sparkSession
    raw, members = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc")
    archives = write_archives(pages, raw, **columns)
    return read_archives(normalise(archives, raw, members), members)
