"""WARC output and input as a chunked record table.

A payload is never one value on its way to or from an archive: it is rows of (record, chunk
number, bytes), each with the digest of the payload up to and including that chunk.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import tidy
from .shared import new_path, partitions, write_table

CHUNK = 256 << 10
#: Bytes of chunks in one Arrow batch.
BATCH = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def payload_digests(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, digest) of each row's whole payload; null counts as empty."""

    def digest(batches):
        for batch in batches:
            raw = [b"" if not x.is_valid else memoryview(x.as_buffer()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([_base32(hashlib.sha1(x).digest()) for x in raw])], ["page_id", "payload_bytes", "digest"])

    return pages.select("page_id", "html").mapInArrow(tidy(digest), "page_id long, payload_bytes long, digest string")


def _chunk_batch(rows: list[tuple], ids: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(ids), ids)], names)


_CHUNK_TYPES = {"page_id": pa.int64(), "row": pa.int64(), "url": pa.string(), "digest": pa.string(), "payload_bytes": pa.int64(), "chunk": pa.int32(), "running": pa.binary(), "data": pa.binary()}


def payload_chunks(pages: DataFrame) -> DataFrame:
    """The chunked record table of ``pages``: one row a chunk, one at least a page.

    ``running`` is the SHA-1 of the payload through this chunk, ``digest`` that of all of it.
    """

    def split(batches):
        rows, held = [], 0
        for batch in batches:
            for page, row, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                raw = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                sha, parts = hashlib.sha1(), []
                for at in range(0, max(len(raw), 1), CHUNK):
                    sha.update(raw[at : at + CHUNK])
                    parts.append((at, sha.digest()))
                whole = _base32(sha.digest())
                for number, (at, running) in enumerate(parts):
                    data = bytes(raw[at : at + CHUNK])
                    rows.append((page, row, url, whole, len(raw), number, running, data))
                    held += len(data) + 200
                    if held >= BATCH:
                        yield _chunk_batch(rows, list(_CHUNK_TYPES.values()), list(_CHUNK_TYPES))
                        rows, held = [], 0
        yield _chunk_batch(rows, list(_CHUNK_TYPES.values()), list(_CHUNK_TYPES))

    source = pages.select("page_id", F.monotonically_increasing_id().alias("row"), "url", "html")
    return source.mapInArrow(tidy(split), "page_id long, row long, url string, digest string, payload_bytes long, chunk int, running binary, data binary")


def _head(page, url, digest: str, size: int, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = "null" if page is None else page
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{name}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = len(http) + (size if refers_to is None else 0)
    return "\r\n".join([*lines, f"Content-Length: {body}", "", ""]).encode() + http


def write_warc(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record a page into gzipped WARC files; the manifest (path, n_records).

    Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the smallest
    page_id is the response and the others revisit it; all smaller payloads are responses.
    A record's chunks stand together in order, so a task writes them one by one and holds a
    chunk at a time; its length and digest are known from the first chunk's row. Null html is
    an empty payload, a null url becomes ``urn:page:<id>``. Repeated rows are written each (of
    equal ids with equal payloads all are responses); a null id is a response of its own.
    Only the manifest's files count. Other columns are not read; an empty table writes none.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    digests = write_table(payload_digests(pages).where("page_id IS NOT NULL").distinct(), "digests")
    firsts = digests.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n", "payload_bytes")
    revisits = digests.join(firsts, "digest").where("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to"))

    def write(batches):
        out, records, squeeze, name = None, 0, None, None
        last = None
        for batch in batches:
            if out is None and batch.num_rows:
                store, path = fs.FileSystem.from_uri(folder)
                name = f"{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for page, row, url, digest, size, chunk, refers_to, data in zip(*cols, batch.column(7)):
                if (page, row) != last:
                    if squeeze is not None:
                        out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
                    squeeze, last, records = zlib.compressobj(6, zlib.DEFLATED, 31), (page, row), records + 1
                    out.write(squeeze.compress(_head(page, url, digest, size, refers_to)))
                if refers_to is None:
                    out.write(squeeze.compress(memoryview(data.as_buffer())))
        if out is not None:
            out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64())], ["path", "n_records"])

    chunks = payload_chunks(pages)
    ready = chunks.join(revisits, ["page_id", "digest"], "left").select("page_id", "row", "url", "digest", "payload_bytes", "chunk", "refers_to", "data").sortWithinPartitions("page_id", "row", "chunk")
    return write_table(ready.mapInArrow(tidy(write), "path string, n_records long"), "manifest")


class _Stream:
    """Bytes of a gzip file of many members, read on as they are asked for."""

    def __init__(self, source):
        self.source, self.plain, self.rest = source, b"", b""
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.inflate.eof:
            self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        raw = self.inflate.unconsumed_tail or self.rest or self.source.read(CHUNK)
        self.rest = b""
        if not raw:
            return False
        self.plain += self.inflate.decompress(raw, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.plain:
            if not self._more():
                return None
        head, _, self.plain = self.plain.partition(mark)
        return head

    def take(self, n: int) -> bytes:
        """At least a byte and n at most; empty at the end."""
        while not self.plain and self._more():
            pass
        out, self.plain = self.plain[:n], self.plain[n:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def _page(name: str | None):
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


_READ_TYPES = {"page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "digest": pa.string(), "chunk": pa.int32(), "last": pa.bool_(), "running": pa.string(), "data": pa.binary()}


def read_warc(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``manifest``.

    One row a chunk: page_id, record_type, refers_to, url, payload_bytes and digest (of the
    full payload; a revisit's from its headers), chunk, last, running (digest of what has been
    read of the payload so far; null for revisits), data (null unless ``payload``). A payload
    that doesn't agree with its record's digest or length fails the read.
    """

    def read(batches):
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_stream(inner, compression=None) as source:
                    stream = _Stream(source)
                    while (head := stream.until(b"\r\n\r\n")) is not None:
                        own = _fields(head)
                        web = stream.until(b"\r\n\r\n")
                        size, left = int(_fields(web)["content-length"]), int(own["content-length"]) - len(web) - 4
                        kind, digest = own["warc-type"], own["warc-payload-digest"].removeprefix("sha1:")
                        base = (_page(own["warc-record-id"]), kind, _page(own.get("warc-refers-to")), own["warc-target-uri"], size, digest)
                        sha, number = hashlib.sha1(), 0
                        if kind == "revisit":
                            rows.append((*base, 0, True, None, None))
                        while kind != "revisit":
                            data = stream.take(min(CHUNK, left)) if left else b""
                            if left and not data:
                                raise ValueError(f"{path} ends within a record")
                            left -= len(data)
                            sha.update(data)
                            rows.append((*base, number, not left, _base32(sha.digest()), data if payload else None))
                            number, held = number + 1, held + 200 + len(data) * payload
                            if held >= BATCH:
                                yield _chunk_batch(rows, list(_READ_TYPES.values()), list(_READ_TYPES))
                                rows, held = [], 0
                            if not left:
                                if _base32(sha.digest()) != digest:
                                    raise ValueError(f"{path}: record {own['warc-record-id']} doesn't agree with its digest")
                                break
                        stream.until(b"\r\n\r\n")
        yield _chunk_batch(rows, list(_READ_TYPES.values()), list(_READ_TYPES))

    spread = manifest.select("path").repartition(partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(tidy(read), "page_id long, record_type string, refers_to long, url string, payload_bytes long, digest string, chunk int, last boolean, running string, data binary")
