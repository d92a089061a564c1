"""Exact dedup by composable polynomial fingerprints.

A text's normal form is the text without the bytes of ``WHITE``. Its fingerprint is the value of its bytes as the
coefficients of a polynomial at 256 modulo a large random prime. Fingerprints of chunks combine:
``f(ab) = f(a) * 256^len(b) + f(b)``, so a huge text is hashed chunk by chunk, in any grouping. Texts of equal length
and fingerprint then meet, sorted, and are compared chunk by chunk as they stream by; only texts whose every byte is
equal share a class, so a collision costs time and not correctness. Memory holds the distinct texts of one fingerprint, by
rule one, and one chunk of the text that streams by.

Cases: null counts as the empty text; empty texts form one class; equal rows (same doc_id and text) are members like
any other and one of them stays; rows with one doc_id and other texts are other documents; a null doc_id sorts after all
others; texts of one length as written and one doc_id are told apart by a hash of the text as written; other columns are
not read, and ``exact_dedup`` keeps them under any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, batch, binary_list, materialize

#: A random prime of 120 bits, drawn once.
MODULUS = 1271577129706546467639956868909983081
CHUNK = 1 << 20
#: A class of more rows than this, and than one 5,000th of all, is dealt out by salt: at most 5,000 classes are.
HOT_ROWS, HOT_SHARE = 2_000, 5_000


def fingerprint(data: bytes, modulus: int = MODULUS) -> int:
    return int.from_bytes(data, "big") % modulus


def combine(left: int, right: int, right_length: int, modulus: int = MODULUS) -> int:
    """The fingerprint of two pieces one after the other."""
    return (left * pow(256, right_length, modulus) + right) % modulus


def chunked_fingerprint(data: bytes, modulus: int = MODULUS, chunk: int = CHUNK) -> int:
    value = 0
    for at in range(0, len(data), chunk):
        piece = data[at : at + chunk]
        value = combine(value, fingerprint(piece, modulus), len(piece), modulus)
    return value


def normal(data: bytes | None) -> bytes:
    return (data or b"").translate(None, WHITE)


def _key(data: bytes, modulus: int) -> bytes:
    return len(data).to_bytes(8, "big") + chunked_fingerprint(data, modulus).to_bytes(16, "big")


_KEYS = pa.schema([("key", pa.binary())])
_PIECES = pa.schema([("key", pa.binary()), ("salt", pa.int32()), ("uid", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("n_chars", pa.int64()), ("piece", pa.binary())])
_ROWS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("n_chars", pa.int64()), ("text_sha256", pa.string()), ("key", pa.binary()), ("salt", pa.int32()), ("branch", pa.int32()), ("hot", pa.bool_()), ("head", pa.binary())])
_DDL = {"binary": "binary", "int32": "int", "int64": "bigint", "string": "string", "bool": "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[str(f.type)]}" for f in schema)


def exact_classes(docs: DataFrame, modulus: int = MODULUS, chunk: int = CHUNK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each row of docs(doc_id, text): uid, doc_id, tag (a hash of the text as written), n_chars,
    text_sha256, keep_uid, keep_id, keep_tag, group_size, kept."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tag"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch({"key": [_key(normal(x), modulus) for x in binary_list(b.column(0))]}, _KEYS)

    counts = docs.select("text").mapInArrow(keys, _ddl(_KEYS)).groupBy("key").count()
    counts = materialize(counts.filter("count > 1"), "op1-counts")
    # A class is hot only past one 5,000th of the rows in groups, so that this list has a fixed bound.
    total = counts.agg(F.sum("count")).first()[0] or 0
    limit = max(hot_rows, total // HOT_SHARE)
    hot = {bytes(r["key"]): -(-r["count"] // limit) for r in counts.filter(F.col("count") > limit).collect()}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            rows = {f.name: [] for f in _PIECES}
            size = 0
            ids, lengths = b.column(0).to_pylist(), pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist()
            for doc_id, tag, n_chars, data in zip(ids, b.column(2).to_pylist(), lengths, binary_list(b.column(1)), strict=True):
                data = normal(data)
                key = _key(data, modulus)
                uid += 1
                parts = max(1, -(-len(data) // chunk))
                for part in range(parts):
                    piece = data[part * chunk : (part + 1) * chunk]
                    for name, value in zip(rows, (key, uid % hot.get(key, 1), uid, part, parts, doc_id, tag, n_chars, piece), strict=True):
                        rows[name].append(value)
                    size += len(piece)
                    if size > 4 * CHUNK:
                        yield batch(rows, _PIECES)
                        rows, size = {f.name: [] for f in _PIECES}, 0
            yield batch(rows, _PIECES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, salt, uid and part. heads: the chunks of each distinct text of the present key."""
        at, heads, alive, own, digest = None, [], [], None, hashlib.sha256()
        for b in batches:
            rows = {f.name: [] for f in _ROWS}
            for key, salt, uid, part, parts, doc_id, tag, n_chars, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (key, salt):
                    at, heads = (key, salt), []
                if part == 0:  # own: the chunks of a text that no head equals, of which the equal first ones are a head's
                    alive, own, digest = list(range(len(heads))), None if heads else [], hashlib.sha256()
                if own is None:
                    left = [h for h in alive if heads[h][part] == piece]
                    if not left:
                        own = heads[alive[0]][:part]
                    alive = left
                if own is not None:
                    own.append(piece)
                digest.update(piece)
                if part + 1 < parts:
                    continue
                fresh = own is not None
                if fresh:
                    heads.append(own)
                    alive = [len(heads) - 1]
                head = b"".join(own) if fresh and key in hot else None
                for name, value in zip(rows, (uid, doc_id, tag, n_chars, digest.hexdigest(), key, salt, alive[0], key in hot, head), strict=True):
                    rows[name].append(value)
            yield batch(rows, _ROWS)

    rows = docs.mapInArrow(pieces, _ddl(_PIECES)).repartition("key", "salt").sortWithinPartitions("key", "salt", "uid", "part").mapInArrow(compare, _ddl(_ROWS))
    rows = materialize(rows, "op1-rows")
    # Salted parts of a hot class: their few heads are equal exactly when their whole bytes are.
    heads = rows.filter(F.col("head").isNotNull())
    first = heads.groupBy("key", "head").agg(F.min(F.struct("salt", "branch")).alias("to"))
    joined = heads.select("key", "salt", "branch", "head").join(first, ["key", "head"]).select("key", "salt", "branch", F.col("to.salt").alias("to_salt"), F.col("to.branch").alias("to_branch"))
    flat = rows.drop("head")
    if hot:
        flat = flat.join(joined, ["key", "salt", "branch"], "left").withColumn("salt", F.coalesce("to_salt", "salt")).withColumn("branch", F.coalesce("to_branch", "branch")).drop("to_salt", "to_branch")
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "uid")).alias("best")
    groups = flat.groupBy("hot", "key", "salt", "branch").agg(best, F.count("*").alias("group_size"))
    shared = groups.filter("group_size > 1").select("hot", "key", "salt", "branch", F.col("best.uid").alias("keep_uid"), F.col("best.doc_id").alias("keep_doc"), F.col("best.tag").alias("keep_own"), "group_size")
    names = ["key", "salt", "branch"]
    out = flat.filter("NOT hot").join(shared.filter("NOT hot").drop("hot"), names, "left")
    if hot:  # at most HOT_SHARE classes, so their rows needn't meet
        out = out.unionByName(flat.filter("hot").join(F.broadcast(shared.filter("hot").drop("hot")), names, "left"))
    alone = F.col("keep_uid").isNull()
    return out.select(
        "uid", "doc_id", "tag", "n_chars", "text_sha256",
        F.coalesce("keep_uid", "uid").alias("keep_uid"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_doc")).alias("keep_id"),
        F.when(alone, F.col("tag")).otherwise(F.col("keep_own")).alias("keep_tag"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.coalesce("keep_uid", "uid") == F.col("uid")).alias("kept"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts one, the longest as written, then the smallest doc_id."""
    own = F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("keep_tag") == F.col("tag"))
    gone = exact_classes(docs).filter(~F.col("kept")).select("doc_id", "tag", own.alias("again")).distinct()
    gone = materialize(gone, "op1-gone")
    other, again = gone.filter("NOT again"), gone.filter("again")

    def same(listed: DataFrame) -> F.Column:
        return docs["doc_id"].eqNullSafe(listed["doc_id"]) & (F.xxhash64(docs["text"]) == listed["tag"])

    left = docs.join(other, same(other), "left_anti")
    # rows equal in doc_id and text to the one that stays: one of them is kept
    if again.isEmpty():
        return left
    copies = left.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, same(again), "left_anti").unionByName(copies)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_classes(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
