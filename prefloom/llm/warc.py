"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a request, a response or revisit, and a metadata record; request and metadata name the
response in WARC-Concurrent-To. Archives are gzip members, one a record, in the shared folder. Records
are streamed both ways: a task holds one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from .base import lookup, shared_path, small_batches, stored

#: Payloads of fewer bytes are never revisits; archives end after so many bytes.
LEAST_BYTES, ARCHIVE_BYTES = 0, 256 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(kind: str, record_id: str, headers: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, **headers, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def one_line(url: str | None) -> str:
    """A URL as a header can carry it: white space and other than printable ASCII as percent escapes."""
    return "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in (url or "").encode())


def _member(data: bytes) -> bytes:
    return gzip.compress(data, compresslevel=3, mtime=0)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html); a stored table (path, records).

    Equal payloads of at least ``least`` bytes meet by digest; only digests are aggregated, and only those that occur
    twice meet the payloads: by broadcast where they are proven few, else by a join that splits a hot digest. A
    revisit names its response's URI. A task writes archives under names of its own, so a task that runs twice
    leaves orphans, never torn archives.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    digests = rows.where(F.length("payload") >= least).select("page_id", "url", "sha1")
    largest = digests.groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))["url"].alias("first_url"), F.count("*").alias("n"))
    dealt = lookup(rows, stored(largest.where("n > 1").drop("n"), "warc-digests"), ["sha1"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_id = uuid.uuid4().hex
        out, path, size, count, made = None, "", 0, 0, []
        for batch in batches:
            names = ("page_id", "url", "sha1", "first_id", "first_url")
            for k, (page_id, url, sha1, first_id, first_url) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                if out is None:
                    path = f"{folder}/captures-{run_id}-{len(made):04d}.warc.gz"
                    fs, at = pafs.FileSystem.from_uri(path)
                    fs.create_dir(os.path.dirname(at), recursive=True)
                    out, size, count = fs.open_output_stream(at, compression=None), 0, 0
                payload = batch.column("payload")[k].as_py()
                base = f"{run_id}/{len(made)}/{count}"
                ids = [f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{base}/{part}')}>" for part in ("request", "response", "metadata")]
                target, digest = {"WARC-Target-URI": one_line(url)}, {"WARC-Payload-Digest": f"sha1:{base32(sha1)}"}
                revisit = first_id is not None and page_id != first_id
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                http = {"Content-Type": "application/http; msgtype=response"}
                if revisit:
                    answer = record("revisit", ids[1], {**target, **digest, **http, "WARC-Profile": REVISIT, "WARC-Refers-To-Target-URI": one_line(first_url), "WARC-Refers-To-Date": DATE}, head)
                else:
                    answer = record("response", ids[1], {**target, **digest, **http}, head + payload)
                ask = record("request", ids[0], {**target, "WARC-Concurrent-To": ids[1], "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\n\r\n")
                about = record("metadata", ids[2], {**target, "WARC-Concurrent-To": ids[1], "Content-Type": "application/warc-fields"}, b"" if page_id is None else f"page-id: {page_id}\r\n".encode())
                for data in (ask, answer, about):
                    size += out.write(_member(data))
                count += 3
                if size >= ARCHIVE_BYTES:
                    out.close()
                    made.append((path, count))
                    out = None
        if out is not None:
            out.close()
            made.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["path", "records"])

    return stored(dealt.select("page_id", "url", "payload", "sha1", "first_id", "first_url").mapInArrow(run, "path string, records long"), "warc-archives")


class Stream:
    """Bytes of a gzip file with any number of members, read as they come."""

    def __init__(self, source):
        self.source, self.gzip, self.buffer, self.rest = source, zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        data = self.rest or self.source.read(1 << 18)
        self.rest = b""
        if not data:
            return False
        if self.gzip.eof:
            self.gzip = zlib.decompressobj(31)
        self.buffer += self.gzip.decompress(data)
        self.rest = self.gzip.unused_data if self.gzip.eof else b""
        return True

    def line(self) -> bytes | None:
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise EOFError("an archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case; the first of a repeated one) and block of each record of an open archive."""
    stream = Stream(source)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), value.strip())
        yield headers, stream.take(int(headers.get("content-length", 0)))


RECORD = "record_id string, type string, concurrent_to string, target_uri string, payload_digest string, payload_bytes long, payload binary, fields string"
ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.string())])


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives in ``files`` (path): ids, type, concurrent-to, and the payload with its digest.

    Payload, bytes and digest of a response are of what the archive holds; a digest that doesn't fit its
    header is an error. A revisit has its header's digest and no bytes. ``payloads``: whether to return
    them.
    """

    def rows(path: str) -> Iterator[tuple]:
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(at, compression=None) as source:
            for h, block in records(source):
                kind, said = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                payload, n, fields = None, None, None
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in h.get("content-type", "") else block
                    n, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if said not in (None, found):
                        raise ValueError(f"{path}: {h.get('warc-record-id')} has another payload than its digest")
                    said = found
                elif kind == "metadata":
                    fields = block.decode("utf-8", "replace")
                yield h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), said, n, payload if payloads else None, fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += 200 + len(row[6] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ARROW)], schema=ARROW)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ARROW)], schema=ARROW)

    n = files.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return files.select("path").repartition(int(n), "path").mapInArrow(run, RECORD)


def transactions(table: DataFrame) -> DataFrame:
    """One nested row per capture of ``table``, a stored table of records: capture_id, response, requests, metadata.

    response is the struct of a response or revisit record; requests and metadata are sorted arrays of
    the records that name it in concurrent-to, empty if none does. Records that name no capture, and
    other types, belong to none. Repeated records are all kept.
    """
    said = lambda kind: (table.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.sort_array(F.collect_list(F.struct("record_id", "target_uri", "fields"))).alias(kind)))
    empty = F.array().cast("array<struct<record_id:string,target_uri:string,fields:string>>")
    base = table.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct("record_id", "type", "target_uri", "payload_digest", "payload_bytes", "payload").alias("response"))
    out = base.join(said("request"), "capture_id", "left").join(said("metadata"), "capture_id", "left")
    return out.select("capture_id", "response", F.coalesce("request", empty).alias("requests"), F.coalesce("metadata", empty).alias("metadata"))


def captures(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """One row per row of ``pages`` as its archives tell: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url an empty URI. Of equal payloads of at least ``least``
    bytes those with the largest page_id are responses (a repeated row too) and the others revisit it;
    rows without page_id are revisits if the payload has a page with one, else responses. A revisit takes
    its size from the response of its digest.
    """
    files = write_archives(pages, shared_path(pages.sparkSession, "warc"), least)
    table = stored(read_archives(files, payloads=False), "warc-records")
    nested = transactions(table)
    page_id = F.regexp_extract(F.coalesce(F.get("metadata", F.lit(0))["fields"], F.lit("")), r"page-id: (-?\d+)", 1)
    flat = nested.select(F.when(page_id != "", page_id.cast("long")).alias("page_id"), F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"))
    flat = stored(flat, "warc-captures")
    origin = stored(flat.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("page_id").alias("origin_id"), F.max("own_bytes").alias("bytes")), "warc-origins")
    revisit = F.col("record_type") == "revisit"
    return flat.join(origin, "payload_digest", "left").select("page_id", F.coalesce("own_bytes", "bytes").alias("payload_bytes"), "payload_digest", "record_type", F.when(revisit, F.col("origin_id")).alias("refers_to"))
