"""WARC archives: a writer with revisit records and a sequential reader.

Each record is a gzip member of its own. The reader inflates an archive piece by piece, cuts records by their
``Content-Length`` and checks the block digest, and for responses the payload digest, of every record; damage raises ``ValueError``.

Archives are rows of a Parquet table in the shared folder (``archive``, ``content``), since only Spark's writers reach that
folder on every store; ``content`` is a whole .warc.gz file of about ``ARCHIVE_BYTES``, or of one record if that is longer.

Defined cases. Null pages are empty payloads. Of records with equal payloads of 100 bytes or more, those with the smallest ``page_id`` are
responses (repeated rows of that id too); others revisit them. Null ids count as larger than any other. Smaller payloads are always responses.
Blanks, line breaks and percent signs in a URL are percent-encoded in the archive, so that it comes back as it was; a null URL is left out and comes back as null.
Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

LEAST_BYTES = 100
ARCHIVE_BYTES = 4 << 20
#: What would not survive in a header line.
ESCAPES = {c: f"%{ord(c):02X}" for c in "%\r\n \t"}
ESCAPED = re.compile("|".join(ESCAPES.values()))
DATE = "1970-01-01T00:00:00Z"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member with one record; a revisit carries the HTTP head and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(ESCAPES.get(c, c) for c in url))
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{_sha256(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(archive: bytes, piece: int = 1 << 16) -> Iterator[bytes]:
    """The inflated gzip members of an archive, fed to zlib ``piece`` bytes at a time."""
    view, at = memoryview(archive), 0
    while at < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            chunk = view[at : at + piece]
            if not chunk:
                raise ValueError("the archive ends inside a record")
            try:
                parts.append(inflate.decompress(chunk))
            except zlib.error as e:
                raise ValueError(f"damaged gzip member: {e}") from e
            at += len(chunk) - len(inflate.unused_data)
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, framed by its Content-Length and checked by its digest."""
    head, cut, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not cut or not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines)}
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise ValueError("the record has no Content-Length")
    block = rest[: int(size)]
    if len(block) != int(size) or rest[int(size) :] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't fit the record")
    if headers.get("warc-block-digest") != f"sha256:{_sha256(block)}":
        raise ValueError("the block doesn't match its digest")
    return headers, block


def _page(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def read_records(archive: bytes) -> Iterator[tuple]:
    """Rows of READ_SCHEMA, in the archive's order."""
    for member in members(archive):
        headers, block = parse(member)
        digest, kind = headers.get("warc-payload-digest", "").removeprefix("sha256:"), headers.get("warc-type")
        head, _, payload = block.partition(b"\r\n\r\n")
        found = re.search(rb"\r\nContent-Length: (\d+)(?:\r\n|$)", head)
        if kind not in ("response", "revisit") or found is None:
            raise ValueError("no record of a page")
        size = int(found[1])
        if kind == "response" and (len(payload) != size or _sha256(payload) != digest):
            raise ValueError("the payload doesn't match its digest")
        url = headers.get("warc-target-uri")
        if url is not None:
            url = ESCAPED.sub(lambda m: chr(int(m[0][1:], 16)), url)
        yield _page(headers.get("warc-record-id")), size, digest, kind, _page(headers.get("warc-refers-to")), url


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import os

    from pyspark import TaskContext

    task, n, parts, size = TaskContext.get().partitionId() if TaskContext.get() else os.getpid(), 0, [], 0
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "digest", "refers_to")]
        for row in range(batch.num_rows):
            page_id, url, html, digest, refers_to = (c[row].as_py() for c in columns)
            parts.append(record(page_id, url, html or b"", digest, refers_to))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_pydict({"archive": [f"{task:06d}-{n:06d}.warc.gz"], "content": [b"".join(parts)]})
                n, parts, size = n + 1, [], 0
    if parts:
        yield pa.RecordBatch.from_pydict({"archive": [f"{task:06d}-{n:06d}.warc.gz"], "content": [b"".join(parts)]})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
    for batch in batches:
        for content in batch.column(0):
            rows = list(read_records(content.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id url html digest refers_to``: ``refers_to`` is the page whose payload a revisit repeats, else null."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.select("*", F.sha2("html", 256).alias("digest"))
    long = F.octet_length("html") >= LEAST_BYTES
    # one row per digest and task goes into the shuffle, however many copies there are
    first = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives to the shared folder; the table of archives."""
    return stored(small_batches(with_revisits(pages)).mapInArrow(_write, "archive string, content binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of the archives."""
    return archives.select("content").mapInArrow(_read, READ_SCHEMA)


def query(pages: DataFrame) -> DataFrame:
    """The digest of op7, a row per page, as read back from the archives."""
    return read_archives(write_archives(pages))
