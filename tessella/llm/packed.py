"""Packed columns: numpy arrays as binary cells, exchanged in buckets.

Spark rows cost some 30 bytes in a shuffle, so 64-bit fingerprints that stand
alone in rows would move several times the text's size. Here a group of
documents (a *home*) sends one row per bucket of the hash space, with its
distinct fingerprints in one binary cell. A home sends a fingerprint once
however often it has it, so a fingerprint that stands in a third of all
documents costs one entry per home.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fingerprints that a bucket should hold on average.
PER_BUCKET = 1 << 20


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def narrow(x: np.ndarray) -> bytes:
    """Integers as their least and what they have above it in as few bytes as all allow."""
    low = int(x.min()) if len(x) else 0
    over = (x.astype(np.int64).view(np.uint64) - np.uint64(low % (1 << 64))) if len(x) else np.zeros(0, np.uint64)
    most = int(over.max()) if len(x) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most < 1 << (8 * np.dtype(k).itemsize))
    return bytes([np.dtype(kind).itemsize]) + low.to_bytes(8, "little", signed=True) + over.astype(kind).tobytes()


def wide(cell) -> np.ndarray:
    """The integers of a ``narrow`` cell."""
    raw = np.frombuffer(cell, np.uint8)
    low = np.uint64(int.from_bytes(raw[1:9].tobytes(), "little"))
    return (raw[9:].copy().view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[int(raw[0])]).astype(np.uint64) + low).view(np.int64)


def bucket_bits(total: int, per_bucket: int = PER_BUCKET) -> int:
    """Leading hash bits that name the bucket, so that buckets hold about ``per_bucket`` of ``total``."""
    return max(3, min(24, int(max(1, total) / per_bucket).bit_length()))


def cuts(sorted_keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first index...) of sorted 64-bit keys: buckets that occur and their boundaries."""
    b = sorted_keys >> np.uint64(64 - bits)
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    return b[at].astype(np.int64), np.append(at, len(b))


def low32(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the bucket's: enough for a filter, whose false hits only cost work."""
    return (keys >> np.uint64(32 - bits)).astype(np.uint32)


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """A 64-bit key of a row's id and text; rows that agree in both are interchangeable."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def homes(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """``home, key, doc_id, text`` and ``more`` columns: documents dealt by their row key, so that
    rows without an id or with one id are spread. Used with the same arguments several times in one
    plan, it is shuffled once and the exchange reused."""
    key = row_key(id_col, text_col)
    return docs.select(F.pmod(key, F.lit(n)).alias("home"), key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c) for c in more))


def repeated_bits(keys_by_bucket: DataFrame) -> DataFrame:
    """``home, bucket, bits`` from ``home, bucket, keys`` (sorted distinct uint32 of a
    home): a bit per key, set if another home has the key too."""

    def reduce(t: pa.Table) -> pa.Table:
        cells = [np.frombuffer(x, np.uint32) for x in t["keys"].to_pylist()]
        every = np.concatenate(cells)
        order = np.argsort(every, kind="stable")
        s = every[order]
        same = np.zeros(len(s) + 1, dtype=bool)
        same[1:-1] = s[1:] == s[:-1]
        hit = np.empty(len(s), dtype=bool)
        hit[order] = same[1:] | same[:-1]
        ends = np.cumsum([len(c) for c in cells])
        bits = [pack(np.packbits(x)) for x in np.split(hit, ends[:-1])]
        return pa.table({"home": t["home"], "bucket": t["bucket"], "bits": pa.array(bits, pa.binary())})

    return keys_by_bucket.groupBy("bucket").applyInArrow(reduce, "home long, bucket long, bits binary")
