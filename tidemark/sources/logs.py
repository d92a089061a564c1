"""Binary record logs as Spark data sources: an append log and a write-ahead log.

A file starts with a 4-byte magic and a version byte. An append-log record is a 4-byte length, the payload and its CRC-32; its
byte offset is its id. A write-ahead record is a length, JSON, CRC-32 and an 8-byte sequence number. Numbers are big-endian.
A cut-off last record ends a file; a wrong checksum is an error.

A log of a whole table is a folder of segments, each written by the task that holds its stretch of the order. Segments count from their
own start; an index of one line a segment, written last, has the offset and the sequence number that each starts at, so records read
back have those of one long file.
"""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

MAGIC = {"log": b"TMLG", "wal": b"TMWL"}
VERSION = 1
HEADER = 5
INDEX = "segments.json"


class CorruptRecord(ValueError):
    pass


def check_header(head: bytes, kind: str) -> None:
    if head[:4] != MAGIC[kind]:
        raise CorruptRecord(f"not a {kind} file")
    if head[4:5] != bytes([VERSION]):
        raise CorruptRecord(f"version {head[4:5].hex()} isn't known")


def records(f: io.BufferedIOBase, kind: str, start: int = 0) -> Iterator[tuple[int, bytes, int, int]]:
    """offset, payload, CRC and sequence number (0 in an append log) from a byte offset on."""
    check_header(f.read(HEADER), kind)
    at = max(HEADER, start)
    f.seek(at)
    tail = 4 if kind == "log" else 12
    while len(head := f.read(4)) == 4:
        size = struct.unpack(">I", head)[0]
        body = f.read(size + tail)
        if len(body) < size + tail:
            return
        payload, crc = body[:size], struct.unpack(">I", body[size : size + 4])[0]
        if zlib.crc32(payload) != crc:
            raise CorruptRecord(f"checksum differs at byte {at}")
        yield at, payload, crc, struct.unpack(">Q", body[size + 4 :])[0] if kind == "wal" else 0
        at += 4 + len(body)


def record(payload: bytes, tail: bytes = b"") -> bytes:
    return struct.pack(">I", len(payload)) + payload + struct.pack(">I", zlib.crc32(payload)) + tail


class AppendLog:
    """Writes and point reads on one machine's file."""

    kind = "log"

    def __init__(self, path: str):
        self.path = path
        if not os.path.exists(path):
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            with open(path, "wb") as f:
                f.write(MAGIC[self.kind] + bytes([VERSION]))

    def append(self, payload: bytes, tail: bytes = b"") -> int:
        with open(self.path, "ab") as f:
            at = f.tell()
            f.write(record(payload, tail))
            f.flush()
            os.fsync(f.fileno())
        return at

    def append_all(self, payloads: Iterable[bytes], tails: Iterable[bytes] = ()) -> int:
        """Appends many records and returns their number; they are on disk together when it returns."""
        n, more = 0, iter(tails)
        with open(self.path, "ab") as f:
            for payload in payloads:
                f.write(record(payload, next(more, b"")))
                n += 1
            f.flush()
            os.fsync(f.fileno())
        return n

    def read_at(self, offset: int) -> bytes:
        with open(self.path, "rb") as f:
            for _, payload, _, _ in records(f, self.kind, offset):
                return payload
        raise EOFError(offset)

    def scan(self, start: int = 0) -> Iterator[tuple[int, bytes]]:
        with open(self.path, "rb") as f:
            yield from ((at, payload) for at, payload, _, _ in records(f, self.kind, start))

    def record_count(self) -> int:
        return sum(1 for _ in self.scan())

    def size(self) -> int:
        return os.path.getsize(self.path)


class MessageQueue:
    """JSON messages with a committed offset for each consumer group."""

    def __init__(self, folder: str):
        self.log, self.offsets_path = AppendLog(os.path.join(folder, "queue.log")), os.path.join(folder, "offsets.json")

    def _offsets(self) -> dict[str, int]:
        if not os.path.exists(self.offsets_path):
            return {}
        with open(self.offsets_path) as f:
            return json.load(f)

    def publish(self, message: dict) -> int:
        return self.log.append(json.dumps(message, default=str).encode())

    def consume(self, group: str, most: int | None = None) -> list[tuple[int, dict]]:
        """Messages after the group's offset; 0 or None for all."""
        out = []
        for at, payload in self.log.scan(self._offsets().get(group, 0)):
            out.append((at, json.loads(payload)))
            if most and len(out) >= most:
                break
        return out

    def ack(self, group: str, offset: int) -> None:
        """Commits up to and with the message at the offset."""
        payload = self.log.read_at(offset)
        self._commit(group, offset + 8 + len(payload))

    def _commit(self, group: str, offset: int) -> None:
        offsets = self._offsets() | {group: offset}
        with open(self.offsets_path + ".new", "w") as f:
            json.dump(offsets, f)
        os.replace(self.offsets_path + ".new", self.offsets_path)

    def reset(self, group: str) -> None:
        self._commit(group, 0)

    def stats(self) -> dict:
        return {"path": self.log.path, "bytes": self.log.size(), "records": self.log.record_count(), "groups": self._offsets()}


class WriteAheadLog(AppendLog):
    kind = "wal"

    def __init__(self, path: str):
        super().__init__(path)
        self.lsn = max((n for _, n in self.replay()), default=0)

    def write(self, record: dict) -> int:
        self.lsn += 1
        self.append(json.dumps(record).encode(), struct.pack(">Q", self.lsn))
        return self.lsn

    def write_all(self, rows: Iterable[dict]) -> int:
        """Many records in one go; returns the last sequence number."""
        start = self.lsn
        self.lsn += self.append_all((json.dumps(r).encode() for r in rows), (struct.pack(">Q", k) for k in count(start + 1)))
        return self.lsn

    def checkpoint(self, lsn: int) -> int:
        return self.write({"type": "checkpoint", "lsn": lsn})

    def replay(self, start: int = 0) -> Iterator[tuple[dict, int]]:
        """Records with a sequence number above start."""
        with open(self.path, "rb") as f:
            yield from ((json.loads(payload), n) for _, payload, _, n in records(f, self.kind) if n > start)


def write_segments(rows: DataFrame, folder: str, payload: str, order: list[str], kind: str = "log") -> list[str]:
    """Writes the payloads of all rows, text or binary, in their order as a log in segments; returns the segments' paths. A null payload is an
    empty one. The folder is new and shared by driver and executors. A task that runs again replaces its segment; the driver gets a line
    for each."""
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        name = f"{task.partitionId():08d}.{kind}"
        temporary = os.path.join(folder, f".{name}.{task.taskAttemptId()}")
        with open(temporary, "wb") as f:
            f.write(MAGIC[kind] + bytes([VERSION]))
            for b in batches:
                for x in b.column(0).to_pylist():
                    n += 1
                    f.write(record(x or b"", struct.pack(">Q", n) if kind == "wal" else b""))
            f.flush()
            os.fsync(f.fileno())
            size = f.tell() - HEADER
        os.replace(temporary, os.path.join(folder, name))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], ["name", "records", "bytes"])

    ordered = rows.select(F.col(payload).cast("binary").alias("payload"), *order).orderBy(*order).select("payload")
    index, offset, lsn = [], HEADER, 0
    for name, n, size in sorted(map(tuple, ordered.mapInArrow(run, "name string, records bigint, bytes bigint").collect())):
        index.append({"name": name, "offset": offset, "lsn": lsn})
        offset, lsn = offset + size, lsn + n
    if not index:
        index.append({"name": f"{0:08d}.{kind}", "offset": HEADER, "lsn": 0})
        with open(os.path.join(folder, index[0]["name"]), "wb") as f:
            f.write(MAGIC[kind] + bytes([VERSION]))
    with open(os.path.join(folder, INDEX + ".new"), "w") as f:
        json.dump(index, f)
    os.replace(os.path.join(folder, INDEX + ".new"), os.path.join(folder, INDEX))
    return [os.path.join(folder, x["name"]) for x in index]


SCHEMA = "path string, offset bigint, payload binary, crc bigint, lsn bigint"


class LogSource(DataSource):
    """spark.read.format("record_log").option("path", file or folder).option("kind", "log" or "wal"); also as a stream of one log."""

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return LogStream(self.options)


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.start = options["path"], options.get("kind", "log"), int(options.get("start", 0))

    def partitions(self) -> list[InputPartition]:
        """A file each, with the offset and sequence number that it starts at."""
        if os.path.exists(index := os.path.join(self.path, INDEX)):
            with open(index) as f:
                return [InputPartition((os.path.join(self.path, x["name"]), x["offset"], x["lsn"])) for x in json.load(f)]
        files = sorted(os.path.join(self.path, x) for x in os.listdir(self.path)) if os.path.isdir(self.path) else [self.path]
        return [InputPartition((f, HEADER, 0)) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, offset, first = partition.value
        with open(path, "rb") as f:
            for at, payload, crc, lsn in records(f, self.kind, self.start - offset + HEADER):
                yield path, at - HEADER + offset, payload, crc, lsn + first


class LogStream(SimpleDataSourceStreamReader):
    """Offsets are bytes; a batch takes at most maxRecords of them."""

    def __init__(self, options: dict):
        self.path, self.kind, self.most = options["path"], options.get("kind", "log"), int(options.get("maxrecords", options.get("maxRecords", 10_000)))

    def initialOffset(self) -> dict:
        return {"at": HEADER}

    def _take(self, start: int, end: int | None) -> tuple[list[tuple], int]:
        out, at = [], start
        with open(self.path, "rb") as f:
            for place, payload, crc, lsn in records(f, self.kind, start):
                if (end is not None and place >= end) or (end is None and len(out) >= self.most):
                    break
                out.append((self.path, place, payload, crc, lsn))
                at = place + 8 + len(payload) + (8 if self.kind == "wal" else 0)
        return out, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, at = self._take(start["at"], None)
        return iter(out), {"at": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._take(start["at"], end["at"])[0])

    def commit(self, end: dict) -> None:
        pass


def read_log(spark: SparkSession, path: str, kind: str = "log", start: int = 0) -> DataFrame:
    spark.dataSource.register(LogSource)
    return spark.read.format("record_log").option("path", path).option("kind", kind).option("start", str(start)).load()


def stream_log(spark: SparkSession, path: str, kind: str = "log", most: int = 10_000) -> DataFrame:
    spark.dataSource.register(LogSource)
    return spark.readStream.format("record_log").option("path", path).option("kind", kind).option("maxRecords", str(most)).load()


def replay(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """lsn, payload text of records above start."""
    return read_log(spark, path, "wal").filter(F.col("lsn") > start).select("lsn", F.col("payload").cast("string").alias("payload"))


def verify(df: DataFrame) -> DataFrame:
    """Rows whose payload doesn't have its checksum."""
    return df.filter(F.crc32("payload") != F.col("crc"))
