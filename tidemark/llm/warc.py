"""WARC archives with their index written first and read back by coalesced byte ranges.

Each task writes its pages into archives of its own (WARC/1.1, one gzip member a record, as readers of ranges expect) and returns a
row of the index for each record: file, offset, length, url, payload digest and what the record is. An archive of a failed
or repeated attempt is in no index, so nothing refers to it. Reading takes index rows, any selection of them, deals them out
by ranges of (file, offset), joins neighbours into one read where little lies between, and parses the records
that it cuts from it. Nothing passes through the driver; a task holds one read.

Of records with equal payloads of at least ``min_bytes``, that with the largest page_id is a response and the others revisit it;
smaller payloads are all responses. Equality is that of SHA-256, as SHA-1, which the archive names, can be made to collide. Only digests are grouped; the join that tells a
page which record it revisits splits a frequent digest by adaptive execution, as both of its sides come from tables.

Cases. Null html is an empty payload, a null url has no target header and stays null in the index. Null page_ids are least; of rows
that share the largest page_id any one is the response. Control characters of a URL are written %XX in the archive, the index has it
as given. An empty table has an empty index and no archives. Other columns are not read.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pf

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, binary_list, discard, materialize, store_path

ARCHIVE_BYTES = 1 << 30
#: Bytes of records for one task; bytes that one read may span; gap that is read rather than skipped.
SHARE, SPAN, GAP = 1 << 26, 1 << 23, 1 << 16
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
_INDEX_DDL = "file string, offset bigint, length bigint, url string, payload_digest string, page_id bigint, record_type string"
_RECORDS = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_record", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
_RECORDS_DDL = "record_id string, page_id bigint, url string, record_type string, refers_to bigint, refers_to_record string, payload_bytes bigint, payload_digest string, payload binary"


def file_system(path: str) -> tuple[pf.FileSystem, str]:
    """The store that holds a path, as tasks reach it."""
    return pf.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}".encode()]
    head += [f"{k}: {v}".encode() for k, v in fields if v is not None] + [f"Content-Length: {len(block)}".encode()]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _record_id(page_id: int | None, uid: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{uid}').urn}>"


class _Archive:
    """One open archive of a task."""

    def __init__(self, folder: str, date: str) -> None:
        store, at = file_system(folder)
        store.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        self.path, self.out, self.size = f"{folder.rstrip('/')}/{name}", store.open_output_stream(f"{at}/{name}", compression=None), 0
        about = b"format: WARC file version 1.1\r\nconformsTo: https://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
        self.add(_record("warcinfo", [("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], about))

    def add(self, data: bytes) -> tuple[int, int]:
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at, len(data)


def kept_of_equal(rows: DataFrame, min_bytes: int) -> DataFrame:
    """digest, n_bytes, keep_page, keep_uid of payloads that more than one of rows(page_id, uid, digest, n_bytes) holds."""
    last = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "uid")).alias("last")
    groups = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(last, F.count("*").alias("n")).filter("n > 1")
    return groups.select("digest", "n_bytes", F.col("last.page_id").alias("keep_page"), F.col("last.uid").alias("keep_uid"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Writes pages(page_id, url, html) into archives below folder, one that driver and executors share; returns the written index."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "page_id", "url", F.unhex(F.sha2("payload", 256)).alias("digest"), F.octet_length("payload").alias("n_bytes"), "payload")
    given = rows = materialize(rows, "op12-rows")  # places of rows can differ from one run to the next: written, they are fixed
    kept = materialize(kept_of_equal(rows.drop("url", "payload"), min_bytes), "op12-kept")
    rows = rows.join(kept, ["digest", "n_bytes"], "left").select("uid", "page_id", "url", "keep_page", "keep_uid", "payload")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            out = {f.name: [] for f in _INDEX}
            for uid, page, url, keep_page, keep_uid, data in zip(*(c.to_pylist() for c in b.columns[:5]), binary_list(b.column(5)), strict=True):
                if own is None or own.size >= archive_bytes:
                    if own is not None:
                        own.out.close()
                    own = _Archive(folder, date)
                name, again = base64.b32encode(hashlib.sha1(data).digest()).decode(), keep_uid is not None and keep_uid != uid
                target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
                fields = [("WARC-Record-ID", _record_id(page, uid)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{name}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", page)]
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                if again:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(keep_page, keep_uid)), ("X-Refers-To-Page-ID", keep_page)]
                kind = "revisit" if again else "response"
                at, length = own.add(_record(kind, fields, block if again else block + data))
                for k, v in zip(out, (own.path, at, length, url, name, page, kind), strict=True):
                    out[k].append(v)
            yield batch(out, _INDEX)
        if own is not None:
            own.out.close()

    index = materialize(rows.mapInArrow(archive, _INDEX_DDL), "op12-index")
    discard(given, kept)
    return index


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def parse(data: bytes) -> dict:
    """One record from the bytes of its gzip member; lengths and the payload's digest are held against the headers."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    size = int(fields["content-length"])
    if not head.startswith(VERSION + b"\r\n") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    kind, digest, n = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(_fields(http)["content-length"])
    if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"record_id": fields["warc-record-id"], "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number("x-refers-to-page-id"), "refers_to_record": fields.get("warc-refers-to"), "payload_bytes": n, "payload_digest": digest, "payload": payload if kind == "response" else None}


def ranges(rows: Iterator[tuple[str, int, int]], span: int = SPAN, gap: int = GAP) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """file, start, end and records of each read, from (file, offset, length) in order of file and offset."""
    file, start, end, own = None, 0, 0, []
    for f, at, n in rows:
        if own and (f != file or at - end > gap or max(end, at + n) - start > span):
            yield file, start, end, own
            own = []
        if not own:
            file, start, end = f, at, at
        own.append((at, n))
        end = max(end, at + n)
    if own:
        yield file, start, end, own


def read(index: DataFrame, span: int = SPAN, gap: int = GAP) -> DataFrame:
    """The records of the given index rows: record_id, page_id, url, record_type, refers_to, refers_to_record, payload_bytes,
    payload_digest, payload (null for revisits; see resolve)."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        path, source = None, None
        out, size = {f.name: [] for f in _RECORDS}, 0
        for file, start, end, own in ranges(places, span, gap):
            if file != path:
                store, at = file_system(file)
                path, source = file, store.open_input_file(at)
            data = source.read_at(end - start, start)
            for at, n in own:
                record = parse(data[at - start : at - start + n])
                for k, v in record.items():
                    out[k].append(v)
                size += 400 + len(record["payload"] or b"")
                if size > span:
                    yield batch(out, _RECORDS)
                    out, size = {f.name: [] for f in _RECORDS}, 0
        yield batch(out, _RECORDS)

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // SHARE))  # index rows are small: their own size says nothing
    places = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(fetch, _RECORDS_DDL)


def resolve(records: DataFrame) -> DataFrame:
    """Records with the payload of what they revisit, where that is among them."""
    whole = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("payload").alias("whole"))
    joined = records.join(whole, "refers_to_record", "left")
    return joined.select(*[F.coalesce("payload", "whole").alias("payload") if c == "payload" else F.col(c) for c in records.columns])


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archives."""
    index = write(pages, store_path(pages.sparkSession, "op12-archives"))
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
