"""What the text operators share: reading tables, cutting lineage, byte and word arithmetic on Arrow batches."""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

WHITE = b" \t\n\x0b\x0c\r"
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The bytes of words that white space parts.
UNSPACED = np.ones(256, dtype=bool)
UNSPACED[list(WHITE)] = False
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20
#: Words of more bytes are hashed one by one; the others by two polynomials modulo primes.
_LONG = 1 << 10
_MODULI = ((2_147_483_647, 1_103_515_249), (2_147_483_629, 1_597_334_677))
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone, with Arrow batches of a bounded size."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Arrow batches of 1 MB at most, or one row: whole texts pass through Python, so rows alone don't bound a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))


def store_path(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, the one that all machines share; set here only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "/tmp/tidemark-checkpoints"  # only a local session has none
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage with a written table in the shared folder; survives lost executors. The shuffle files of the write go with it."""
    spark = df.sparkSession
    path, before = store_path(spark, label), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def binary_list(column: pa.Array) -> list:
    """The bytes of each text; None for null."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def letters(text: str) -> bool:
    return re.search(r"[^\W\d_]", text) is not None


def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each modulus the powers of its base and of the base's inverse, for every place of a block."""
    if not _POWERS:
        for p, base in _MODULI:
            both = []
            for b in (base, pow(base, -1, p)):
                out = np.ones(1, dtype=np.uint64)
                while len(out) < _BLOCK + _LONG:
                    out = np.concatenate([out, out * np.uint64(pow(b, len(out), p)) % np.uint64(p)])
                both.append(out[: _BLOCK + _LONG])
            _POWERS.append((both[0], both[1]))
    return _POWERS


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given words, which depend on the words' bytes and lengths alone.

    A short word is a polynomial modulo two primes whose coefficients are its bytes and one more, so no byte counts as nothing.
    """
    sizes = ends - starts
    out = np.zeros(len(starts), dtype=np.uint64)
    long = sizes > _LONG
    for k in np.flatnonzero(long).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(~long)
    at = 0
    while at < len(short):
        origin = int(starts[short[at]])
        until = int(np.searchsorted(starts[short], origin + _BLOCK))
        own = short[at:until]
        s, e = starts[own] - origin, ends[own] - origin
        block = raw[origin : origin + int(e[-1])].astype(np.uint64) + np.uint64(1)
        parts = []
        for (p, _), (up, down) in zip(_MODULI, _powers(), strict=True):
            sums = np.zeros(len(block) + 1, dtype=np.uint64)
            np.cumsum(block * up[: len(block)], out=sums[1:])
            parts.append((sums[e] - sums[s]) % np.uint64(p) * down[s] % np.uint64(p))
        out[own] = mix((parts[0] << np.uint64(32) | parts[1]) + (e - s).astype(np.uint64) * np.uint64(_BASE))
        at = until
    return out


def words_of(raw: np.ndarray, cuts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the runs of bytes that table holds; no word reaches over a cut.

    cuts: ascending places, such as where texts start. Bytes are read in blocks that end between words.
    """
    n, at, parts = len(raw), 0, []
    while at < n:
        end = min(n, at + _BLOCK)
        while end < n:
            outside = np.flatnonzero(~table[raw[end - 1 : end + _BLOCK]])
            if len(outside):
                end += max(0, int(outside[0]) - 1)
                break
            end = min(n, end + _BLOCK)
        inside = table[raw[at:end]]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, end)] - at] = True
        edge[0] = edge[-1] = True
        padded = np.zeros(len(inside) + 2, dtype=bool)
        padded[1:-1] = inside
        parts.append((np.flatnonzero(inside & (~padded[:-2] | edge[:-1])) + at, np.flatnonzero(inside & (~padded[2:] | edge[1:])) + 1 + at))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, ends = (np.concatenate(p) for p in zip(*parts, strict=True))
    return starts, ends, word_hashes(raw, starts, ends)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n consecutive words, from the words' hashes."""
    size = max(0, len(codes) - n + 1)
    total = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(_BASE) + mix(codes[k : k + size] + np.uint64(k + 1))
    return mix(total)


def texts_of(column: pa.Array, table: bytes | None = None) -> tuple[bytes, np.ndarray]:
    """The texts of a column one after the other, null as empty, and where each starts; the last place is the end."""
    parts = [x or b"" for x in binary_list(column)]
    data = b"".join(parts)
    return data.translate(table) if table else data, np.cumsum([0] + [len(x) for x in parts])
