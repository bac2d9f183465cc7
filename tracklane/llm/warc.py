"""WARC archives of pages: written with one gzip member per record, read back record by record.

Payload digests decide which record of a group of equal payloads is the response; the others revisit it and carry no
payload. Groups are found by a pre-aggregated minimum per digest and a plain join, so a payload that a third of all
pages share is one row on one side and can be split on the other. Archives are files of the tasks that write them; the
rows that those tasks return, kept as a table in the shared folder, say which archives count.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import batches, fresh_dir, materialize, open_in, open_out, partitions, text_of

LEAST_BYTES = 100
MAX_ARCHIVE = 256 << 20
CHUNK = 1 << 16
ID = "urn:tracklane:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the tables hold no time of capture

ARCHIVES = pa.schema([("uri", pa.string()), ("n_records", pa.int64())])
RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64())])


class Damaged(ValueError):
    """An archive that breaks the format, or a record whose digest or length does not hold."""


class Record(NamedTuple):
    headers: dict[str, str]  # names in lower case
    block: bytes


def _name(page_id: int | None) -> str:
    return f"<{ID}{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    m = re.fullmatch(rf"<{ID}(-?\d+)>", name or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]+', '%20', url)}", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *((f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}") if revisit else ()),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, source: BinaryIO, rest: bytes):
        self.source, self.rest, self.z, self.held = source, rest, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.rest or self.source.read(CHUNK)
        if not self.z.unconsumed_tail:
            self.rest = b""
        if not data:
            raise Damaged("archive ends inside a gzip member")
        try:
            self.held += self.z.decompress(data, CHUNK)
        except zlib.error as e:
            raise Damaged(str(e)) from e
        if self.z.eof:
            self.rest = self.z.unused_data + self.rest
        return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        at = 0
        while (i := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if len(self.held) > most or not self._more():
                raise Damaged("record head without end")
        out = bytes(self.held[:i])
        del self.held[:i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise Damaged("record is shorter than its Content-Length")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def finish(self) -> bytes:
        """Read to the end of the member and return what follows it."""
        while self._more():
            if len(self.held) > 4:
                break
        if not self.z.eof or self.held:
            raise Damaged("record is longer than its Content-Length")
        return self.rest


def read_records(source: BinaryIO) -> Iterator[Record]:
    """Records of an archive in order, one gzip member each; block digests are verified."""
    rest = b""
    while True:
        rest = rest or source.read(CHUNK)
        if not rest:
            return
        m = _Member(source, rest)
        head = m.until(b"\r\n\r\n").decode().split("\r\n")
        if not head[0].startswith("WARC/1."):
            raise Damaged("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        if not headers.get("content-length", "").isdigit():
            raise Damaged("record without Content-Length")
        block = m.take(int(headers["content-length"]))
        if m.take(4) != b"\r\n\r\n":
            raise Damaged("record is longer than its Content-Length")
        rest = m.finish()
        want = headers.get("warc-block-digest")
        if want and want != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise Damaged("block digest does not hold")
        yield Record(headers, block)


def page_of(r: Record) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to; a response's payload is verified."""
    http, _, payload = r.block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^Content-Length: *(\d+)", http)
    digest = r.headers["warc-payload-digest"].removeprefix("sha256:")
    kind = r.headers["warc-type"]
    if kind == "response" and (size is None or int(size[1]) != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise Damaged("payload digest or length does not hold")
    return (_page(r.headers["warc-record-id"]), r.headers.get("warc-target-uri", ""), int(size[1]), digest, kind,
            _page(r.headers.get("warc-refers-to")) if kind == "revisit" else None)


def plan(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html and digest of every page, with `first`, the smallest page_id of equal payloads of `least` bytes."""
    marked = pages.select("page_id", text_of("url").alias("url"), text_of("html").alias("html")).withColumn("digest", F.sha2("html", 256))
    shared = (marked.where(F.octet_length("html") >= least).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return marked.join(shared, "digest", "left")


def write(pages: DataFrame, folder: str | None = None, max_archive: int = MAX_ARCHIVE) -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html) and return the archives (uri, n_records) as a stored table.

    Null html is an empty payload. Of equal payloads of at least LEAST_BYTES the smallest page_id is the response; rows
    that repeat this page_id and payload are the same capture and responses too. Null page_ids are revisits where an
    equal payload has an id, else responses. No rows: no archives.
    """
    folder = folder or fresh_dir(pages.sparkSession, "warc")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        for batch in rows:
            for page, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out, n = open_out(folder, ".warc.gz"), 0
                revisit = first is not None and page != first
                out.write(member(record(page, url, html.encode("utf-8", "surrogatepass"), digest, first, revisit)))
                n += 1
                if out.size >= max_archive:
                    out.close()
                    yield pa.RecordBatch.from_pylist([{"uri": out.uri, "n_records": n}], schema=ARCHIVES)
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"uri": out.uri, "n_records": n}], schema=ARCHIVES)

    rows = plan(pages).select("page_id", "url", "html", "digest", "first")
    return materialize(rows.mapInArrow(run, "uri string, n_records long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """One row per record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pages() -> Iterator[tuple]:
            for batch in rows:
                for uri, n in zip(*(c.to_pylist() for c in batch.columns)):
                    seen = 0
                    with open_in(uri) as f:
                        for r in read_records(f):
                            seen += 1
                            yield page_of(r)
                    if seen != n:
                        raise Damaged(f"{uri} holds {seen} records, {n} were written")

        yield from batches(pages(), RECORDS)

    return (archives.select("uri", "n_records").repartition(partitions(archives.sparkSession), "uri").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"))
