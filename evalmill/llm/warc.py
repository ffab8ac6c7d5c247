"""WARC archives: one gzip member per record, written and read in sequence.

The reader inflates member by member with incremental zlib, frames each record
by its Content-Length and verifies block and payload digests.

Defined results: a null payload is an empty one; equal payloads of at least
``least_bytes`` become one response (the smallest id) and revisits of it,
smaller ones are all responses; repeated rows of the smallest id are all
responses; a truncated member, a wrong length or digest raises; an empty table
gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

EMPTY_URL = "urn:none"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head."""
        return self.block.partition(b"\r\n\r\n")[2]


def member(headers: dict[str, str], block: bytes, level: int = 1) -> bytes:
    """One record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    raw = b"WARC/1.1\r\n" + f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, str(page_id))}>"


def one_line(value: str | None) -> str:
    return "".join(value.split()) if value and value.strip() else EMPTY_URL


def page_record(page_id: int | None, url: str | None, html: str | None, digest: str, size: int, response: int | None) -> bytes:
    """A response with its payload, or a revisit of ``response`` with the HTTP head alone."""
    revisit = response is not None
    payload = (html or "").encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": one_line(url),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(),
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if revisit:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(response), "X-Refers-To-Page-ID": str(response), "WARC-Truncated": "length"}
    return member(headers, block)


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated members of a stream of compressed chunks, one at a time."""
    z, out, begun = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            out.append(z.decompress(chunk))
            begun, chunk = True, b""
            if z.eof:
                yield b"".join(out)
                chunk, z, out, begun = z.unused_data, zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("the last gzip member is cut short")


def parse(raw: bytes) -> Record:
    """One inflated record, framed by its Content-Length, digests verified."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not mark or not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(headers["Content-Length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ValueError(f"record {headers.get('WARC-Record-ID')} does not end where its Content-Length says")
    record = Record(headers, block)
    checks = [("WARC-Block-Digest", block)]
    if headers.get("WARC-Type") != "revisit":
        checks.append(("WARC-Payload-Digest", record.payload))
    for name, data in checks:
        if name in headers:
            algorithm, _, value = headers[name].partition(":")
            found = hashlib.new(algorithm.lower(), data)
            if value.lower() != found.hexdigest() and value.upper() != base64.b32encode(found.digest()).decode():
                raise ValueError(f"{name} of record {headers.get('WARC-Record-ID')} does not hold")
    return record


def read_records(chunks: Iterator[bytes]) -> Iterator[Record]:
    for raw in members(chunks):
        yield parse(raw)


def http_length(block: bytes) -> int:
    for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value)
    raise ValueError("the HTTP head has no Content-Length")


def archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, archive_bytes: int = 4 << 20) -> DataFrame:
    """Rows of (name, content): gzip archives of about ``archive_bytes``, in the order the tasks read the pages."""
    data = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    given = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha2(data, 256).alias("digest"), F.octet_length(data).cast("long").alias("size"))
    # Grouped by one column more than joined by, so that the join deals both sides anew and can split a hot digest.
    long_ = given.where(F.col("size") >= least_bytes).select("id", "digest", "size")
    firsts = long_.groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    # Small pages match no digest; their keys differ, so that they spread over tasks.
    key = F.when(F.col("size") >= least_bytes, F.col("digest")).otherwise(F.concat_ws(" ", F.lit("small"), F.col("id").cast("string"), "url"))
    marked = given.join(firsts, key == F.col("d"), "left")
    response = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    # Revisits carry no payload, so their text stays behind.
    rows = marked.select("id", "url", F.when(response.isNull(), F.col("html")).alias("html"), "digest", "size", response.alias("response"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[bytes] = []
        size = 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                known = [None if pd.isna(v) else int(v) for v in (row.id, row.response)]
                record = page_record(known[0], row.url, row.html, row.digest, int(row.size), known[1])
                parts.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield pd.DataFrame({"content": [b"".join(parts)]})
                    parts, size = [], 0
        if parts:
            yield pd.DataFrame({"content": [b"".join(parts)]})

    return rows.mapInPandas(write, "content binary")


def read_archives(contents: DataFrame, column: str = "content", chunk_bytes: int = 1 << 16) -> DataFrame:
    """Records of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf[column]:
                view = memoryview(content)
                rows = []
                for r in read_records(bytes(view[i : i + chunk_bytes]) for i in range(0, len(view), chunk_bytes)):
                    h = r.headers
                    page, to = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                    size = len(r.payload) if h["WARC-Type"] == "response" else http_length(r.block)
                    rows.append((int(page) if page else None, size, h["WARC-Payload-Digest"].partition(":")[2], h["WARC-Type"], int(to) if to else None, h["WARC-Target-URI"]))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return contents.select(column).mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def read_files(spark, path: str) -> DataFrame:
    """Records of ``.warc.gz`` files under a path that Spark can read."""
    return read_archives(spark.read.format("binaryFile").load(path))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archives kept in the cluster's shared folder, then read back."""
    return read_archives(cut(archives(pages, **options)))
