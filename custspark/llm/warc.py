"""WARC archives with an index (operator 9).

Writing: every task streams its pages into an archive of its own in the
shared folder, each record a gzip member of its own as in `.warc.gz` files, and
emits one index row a record: file, offset, length (of the member), URL, digest.  Of records with equal payloads of at least ``REVISIT_BYTES`` the
one with the smallest page id is a ``response``; the others are
``revisit`` records that carry headers alone and name it.

Reading: selected index rows are dealt out by (file, stretch of the file)
and sorted by offset; neighbouring byte ranges are coalesced into one read
each, from which the records are parsed.  The payload size and digest of a
response come from the bytes read, those of a revisit from its record (the
payload is the one of the response it names).

Null payloads are empty.  A page with a null id is always a response.
Pages that repeat an id with the same payload have records of equal kind.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import create_file, materialize, open_file, scratch_path, tidy

REVISIT_BYTES = 100
#: Bytes of records that a task reads, about.
TASK_BYTES = 16 << 20
#: Ranges at most this far apart are read in one go, up to READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Bytes after which a task begins its next archive.
FILE_BYTES = 1 << 30
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string"


def _record(kind: str, page_id: int | None, url: str, digest: str, size: int, refers: tuple[int, str] | None, body: bytes) -> bytes:
    """One WARC/1.1 record.  The date is fixed: the pages have none, and the same input gives the same archive."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To-Target-URI: {refers[1]}", f"X-Refers-To-Page: {refers[0]}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """``(headers, payload)`` of one record."""
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record begins here")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = raw[cut + 4:cut + 4 + int(headers["Content-Length"])]
    return headers, block[block.index(b"\r\n\r\n") + 4:]


def _clean(url: str | None) -> str:
    """A URL that keeps to its header line."""
    return "".join(c for c in (url or "") if c not in "\r\n")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write one record a page; returns the index, a table of the shared folder."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
                        F.sha2(html.cast("binary"), 256).alias("digest"))
    # the first of each payload: digests and ids alone, combined before they are shuffled
    narrow = rows.where((F.octet_length("html") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("digest", "page_id", "url")
    heads = (narrow.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("most"))
             .where(F.col("most") > F.col("first.page_id")).drop("most"))
    again = (narrow.select("digest", "page_id").join(heads, "digest").where(F.col("page_id") > F.col("first.page_id"))
             .select("page_id", "digest", "first").distinct())
    full = rows.join(again, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at = None, "", 0
        for b in batches:
            index = []
            for page, digest, url, html, first in zip(*(b.column(i).to_pylist() for i in range(5))):
                if out is None:
                    uri, out = create_file(folder, f"pages-{uuid.uuid4().hex}.warc.gz")
                    at = 0
                payload, url = html.encode(), _clean(url)
                refers = None if first is None else (first["page_id"], _clean(first["url"]))
                kind = "response" if refers is None else "revisit"
                body = _HTTP % len(payload) + (payload if refers is None else b"")
                raw = gzip.compress(_record(kind, page, url, digest, len(payload), refers, body), mtime=0)
                out.write(raw)
                index.append({"page_id": page, "file": uri, "offset": at, "length": len(raw), "url": url,
                              "payload_digest": digest, "record_type": kind})
                at += len(raw)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if index:
                yield pa.RecordBatch.from_pylist(index, pa.schema(
                    [("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                     ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string())]))
        if out is not None:
            out.close()

    return materialize(full.select("page_id", "digest", "url", "html", "first").mapInArrow(tidy(run), INDEX), "warc-index")


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the given index rows: ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to[,
    payload])``.  ``index`` may be any selection of the written one."""
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
              + (", payload binary" if with_payload else ""))

    def coalesced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        file, spans = None, []
        for b in batches:
            for f, at, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if spans and (f != file or at - sum(spans[-1]) > GAP_BYTES or at + n - spans[0][0] > READ_BYTES):
                    yield file, spans
                    spans = []
                file = f
                spans.append((at, n))
        if spans:
            yield file, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, name = None, None
        for file, spans in coalesced(batches):
            if file != name:
                if handle is not None:
                    handle.close()
                handle, name = open_file(file), file
            base = spans[0][0]
            raw = handle.read_at(sum(spans[-1]) - base, base)
            rows = []
            for at, n in spans:
                head, payload = parse_record(gzip.decompress(raw[at - base:at - base + n]))
                revisit = head["WARC-Type"] == "revisit"
                page = head.get("X-Page-ID")
                rows.append({"page_id": None if page is None else int(page), "url": head["WARC-Target-URI"],
                             "payload_bytes": int(head["X-Payload-Length"]) if revisit else len(payload),
                             "payload_digest": head["WARC-Payload-Digest"].split(":")[1] if revisit else hashlib.sha256(payload).hexdigest(),
                             "record_type": head["WARC-Type"], "refers_to": int(head["X-Refers-To-Page"]) if revisit else None,
                             "payload": None if revisit else payload})
            yield pa.RecordBatch.from_pylist(rows, pa.schema(
                [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                 ("record_type", pa.string()), ("refers_to", pa.int64())] + ([("payload", pa.binary())] if with_payload else [])))
        if handle is not None:
            handle.close()

    # stretches of a file, dealt to as many tasks as the bytes ask for (a stated number is not merged again)
    stretch = F.floor(F.col("offset") / F.lit(READ_BYTES))
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    return (index.select("file", "offset", "length").repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")
            .mapInArrow(tidy(run), schema))


def archive(pages: DataFrame, with_payload: bool = False, **names) -> DataFrame:
    """Write the archives below the shared folder and read all records back."""
    index = write_archives(pages, scratch_path(pages.sparkSession, "warc"), **names)
    return read_records(index, with_payload)
