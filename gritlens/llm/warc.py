"""Web archives as tables of record chunks.

A record of any length is rows of bounded size: (archive, record, chunk, data).
The data of a record's chunks, in order, are its bytes in WARC 1.1; the first
chunk holds the headers. Each row carries the running CRC-32 of the payload so
far, so a reader checks and continues from any chunk, and neither side ever
holds a whole record apart from the row it was given. Of records with equal
payloads the one with the largest page_id is a response, the others revisit it.

One row per page goes through the shuffle that finds equal payloads, combined by
payload before it. The repeated digests are then joined to the pages: while they are
few enough to be broadcast no payload moves, beyond that all are shuffled by their
digest once. Reading parses records
of one chunk where they lie; only records of several chunks are brought together,
and are parsed chunk by chunk.

Rules for odd rows: a null html is an empty payload, a null url an empty target.
Control characters in a url are escaped. A null page_id is smaller than any
other. Rows that repeat both the largest page_id and its payload are responses
all. An empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritlens.llm.store import Stage, tasks_for

CHUNK = 256 << 10
DATE = "2024-01-01T00:00:00Z"  # written into every record, so that reruns agree
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE = "archive int, record bigint, chunk bigint, last boolean, crc32 bigint, data binary"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _name(page_id) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(name: str):
    value = name.strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def _headers(page_id, url, size: int, digest: str, refers_to, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=chr(33) + '#$%&()*+,/:;=?@[]~' + chr(39))}",
             f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(http) + (0 if revisit else size)}", "", ""]
    return "\r\n".join(lines).encode() + http.encode()


def _payload_digest(payload: memoryview, step: int) -> str:
    found = hashlib.sha1()
    for at in range(0, len(payload), step):
        found.update(payload[at : at + step])
    return base64.b32encode(found.digest()).decode()


def _record_chunks(headers: bytes, payload: memoryview, step: int) -> Iterator[tuple[int, bool, int, bytes]]:
    """(chunk, last, running CRC-32 of the payload, data)."""
    crc, number, end = 0, 0, b"\r\n\r\n"
    for at in range(0, max(len(payload), 1), step):
        part = payload[at : at + step]
        crc = zlib.crc32(part, crc)
        last = at + step >= len(payload)
        yield number, last, crc, b"".join([headers if not number else b"", part, end if last else b""])
        number += 1


def _write(step: int):
    """(page_id, url, html, keeper, copies) as rows of the archive."""

    def rows_of(held):
        columns = list(zip(*held))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
        names = ("archive", "record", "chunk", "last", "crc32", "data")
        return pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, record, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            page, url, keeper, copies = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            html = batch.column(2).cast(pa.large_string()).fill_null("")
            _, places, data = html.buffers()
            places = np.frombuffer(places, np.int64)[html.offset : html.offset + len(html) + 1].tolist() if len(html) else [0]
            data = memoryview(data) if data is not None else memoryview(b"")
            for i, page_id in enumerate(page):
                payload = data[places[i] : places[i + 1]]
                revisit = copies[i] is not None and page_id != keeper[i]
                headers = _headers(page_id, url[i], len(payload), _payload_digest(payload, step), keeper[i], revisit)
                body = memoryview(b"") if revisit else payload
                for number, last, crc, part in _record_chunks(headers, body, step):
                    held.append((archive, record, number, last, crc, part))
                    size += len(part)
                    if size > 16 * step:
                        yield rows_of(held)
                        held, size = [], 0
                record += 1
        if held:
            yield rows_of(held)

    return run


def write_archive(pages: DataFrame, stage: Stage, smallest: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The archive of all pages, written; equal payloads under ``smallest`` bytes are kept each."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    equal = (
        pages.filter(F.octet_length("html") >= smallest)
        .groupBy(digest.alias("digest"))
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
        .filter("copies > 1")
    )
    equal = stage.keep(equal, "equal")  # its true size decides how it is joined
    if equal.isEmpty():
        marked = pages.select("page_id", "url", "html", F.lit(None).cast("bigint").alias("keeper"), F.lit(None).cast("bigint").alias("copies"))
    else:
        marked = pages.withColumn("digest", digest).join(equal, "digest", "left").select("page_id", "url", "html", "keeper", "copies")
    return stage.keep(marked.mapInArrow(_write(chunk), ARCHIVE), "archive")


class _Reader:
    """Parses the chunks of one record in order."""

    def __init__(self, first: bytes):
        block = first.index(b"\r\n\r\n") + 4
        head = dict(x.split(": ", 1) for x in first[: block - 4].decode().split("\r\n")[1:])
        body = first.index(b"\r\n\r\n", block) + 4
        http = dict(x.split(": ", 1) for x in first[block : body - 4].decode().split("\r\n")[1:])
        self.kind, self.stated = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        self.page_id, self.size = _page(head["WARC-Record-ID"]), int(http["Content-Length"])
        self.refers_to = _page(head["WARC-Refers-To"]) if self.kind == "revisit" else None
        self.left = int(head["Content-Length"]) - (body - block)
        self.sha1, self.crc = hashlib.sha1(), 0
        self.skip = body

    def add(self, data: bytes, crc: int) -> None:
        part = memoryview(data)[self.skip : self.skip + self.left]
        self.skip, self.left = 0, self.left - len(part)
        self.sha1.update(part)
        self.crc = zlib.crc32(part, self.crc)
        if self.crc != crc:
            raise ValueError(f"a chunk of page {self.page_id} is damaged")

    def result(self):
        found = base64.b32encode(self.sha1.digest()).decode()
        if self.left or self.kind == "response" and found != self.stated:
            raise ValueError(f"the record of page {self.page_id} is damaged")
        return self.page_id, self.size, self.stated, self.kind, self.refers_to


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(archive, record, chunk, last, crc32, data), each record's chunks in order."""
    reader = None
    for batch in batches:
        found = []
        chunk, last, crc = (batch.column(i).to_pylist() for i in (2, 3, 4))
        data = batch.column(5)
        for i in range(batch.num_rows):
            part = data[i].as_py()
            if not chunk[i]:
                reader = _Reader(part)
            reader.add(part, crc[i])
            if last[i]:
                found.append(reader.result())
        columns = list(zip(*found)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        yield pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def read_archive(archive: DataFrame) -> DataFrame:
    """One row per record, from its bytes; a damaged record is an error."""
    single = archive.filter("chunk = 0 and last")
    several = archive.filter("not (chunk = 0 and last)")
    ordered = several.repartition(tasks_for(archive), "archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return single.mapInArrow(_parse, RECORD).union(ordered.mapInArrow(_parse, RECORD))


def round_trip(pages: DataFrame, smallest: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write all pages, read them back."""
    return read_archive(write_archive(pages, Stage(pages.sparkSession, "warc"), smallest, chunk))
