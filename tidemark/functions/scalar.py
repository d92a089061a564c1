"""Scalar functions on columns."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell_hash(key: Column, row: Column, width: int) -> Column:
    """The sketch's column for a key in a row: the first 8 bytes of SHA-256 of the row as 4 bytes and the key, modulo width."""
    seed = F.unhex(F.lpad(F.hex(row.cast("long")), 8, "0"))
    digest = F.sha2(F.concat(seed, F.encode(key, "UTF-8")), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(width)).cast("int")


def fnv1a_64(data: bytes) -> int:
    value = 0xCBF29CE484222325
    for b in data:
        value = (value ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


@F.pandas_udf(T.DecimalType(20, 0))
def fnv1a(texts: pd.Series) -> pd.Series:
    """All texts of a batch at once, byte place by byte place."""
    from decimal import Decimal

    data = [b"" if t is None else t.encode() for t in texts]
    sizes = np.array([len(x) for x in data], dtype=np.int64)
    raw, starts = np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum(sizes) - sizes
    value = np.full(len(data), 0xCBF29CE484222325, dtype=np.uint64)
    left = np.argsort(-sizes, kind="stable")
    for k in range(int(sizes.max(initial=0))):
        left = left[: int(np.searchsorted(-sizes[left], -k))]
        value[left] = (value[left] ^ raw[starts[left] + k]) * np.uint64(0x100000001B3)
    return pd.Series([None if t is None else Decimal(v) for t, v in zip(texts, value.tolist(), strict=True)], index=texts.index)


@F.pandas_udf(T.StringType())
def feature_hash(vectors: pd.Series) -> pd.Series:
    """SHA-256 of the vector's compact JSON, values rounded to 8 places as Python writes them."""
    return vectors.map(lambda v: None if v is None else hashlib.sha256(json.dumps([round(float(x), 8) for x in v], separators=(",", ":")).encode()).hexdigest())


def crc_matches(payload: Column, crc: Column) -> Column:
    return F.crc32(payload) == crc


def sigmoid(x: Column) -> Column:
    """Without overflow for large |x|."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def log_odds(p: Column, floor: float = 1e-7) -> Column:
    q = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), p))
    return F.log(q / (1 - q))


def clean_number(x: Column) -> Column:
    """NaN and infinities become 0; null too."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def default(x: Column, value) -> Column:
    """x, or the value for null and NaN."""
    return F.coalesce(x, F.lit(value))


def number_default(x: Column, value: float) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(value))


def flag_number(x: Column) -> Column:
    """T is 1, F and unknown text 0, numbers themselves."""
    text = x.cast("string")
    return F.when(text == "T", 1.0).when(text == "F", 0.0).otherwise(F.coalesce(text.try_cast("double"), F.lit(0.0)))


def digitize(x: Column, edges: Column) -> Column:
    """How many edges are at or below x."""
    return F.size(F.filter(edges, lambda e: e <= x))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / std


def kernel_weights(d: int) -> list[float]:
    """Shapley kernel weights by coalition size; 0 at the ends."""
    return [0.0 if s in (0, d) else (d - 1) / (math.comb(d, s) * s * (d - s)) for s in range(d + 1)]


def version_string(kind: Column, day: Column, digest: Column) -> Column:
    return F.concat_ws("-", kind, F.date_format(day, "yyyyMMdd"), F.substring(digest, 1, 4))


def mcc_label(code: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), code)


def epoch_micros(text: Column) -> Column:
    """Microseconds of an ISO timestamp, UTC where it names no zone, whatever the session's; 0 where it can't be read."""
    utc = [F.try_to_timestamp(F.concat(text, F.lit(zone))) for zone in ("Z", "T00:00:00Z")]
    return F.coalesce(F.unix_micros(F.coalesce(*utc, F.try_to_timestamp(text))), F.lit(0))
