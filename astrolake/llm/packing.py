"""Compact exchange rows: many small records of one task travel as one blob per bucket.

A shuffle of one row per shingle or suffix would move tens of bytes for each;
here a task sorts the records of about ``FLUSH_BYTES`` of text, cuts them by
bucket, and sends each bucket one zstd blob of byte-transposed integer arrays.
Buckets are as many as the input asks for (``bucket_count``), so the reduce
side handles a bounded amount whatever the size of the corpus.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from astrolake.sources.shared import drop, shared_folder, written  # noqa: F401

FLUSH_BYTES = 8 << 20

BLOB_SCHEMA = "bucket long, blob binary"
BLOB_ARROW = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    """Serialise integer arrays (any lengths) into one compressed blob."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(struct.pack("<4sQ", a.dtype.str.encode().ljust(4), len(a)))
        parts.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays given to ``pack``."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    (count,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(count):
        kind, n = struct.unpack_from("<4sQ", data, at)
        dtype, at = np.dtype(kind.decode().strip()), at + 12
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def delta(a: np.ndarray) -> np.ndarray:
    """First value, then differences; small numbers for sorted input."""
    out = a.copy()
    out[1:] -= a[:-1]
    return out


def undelta(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)


def blob_batch(rows: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    buckets, blobs = [], []
    for bucket, blob in rows:
        buckets.append(bucket)
        blobs.append(blob)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], schema=BLOB_ARROW)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Bucket numbers and their slices, of an array sorted by bucket."""
    if len(bucket):
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
            yield int(bucket[a]), slice(int(a), int(b))


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and group numbers of runs of equal keys in arrays sorted by them."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries give memory back by themselves
    _trim = None


def released(made):
    """``made``, after memory that a worker no longer needs has gone back to the system: workers live long and share executors."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
    return made


def text_size(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows, and bytes of a string column."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(column))).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def bucket_count(size: int, each: int, least: int = 12) -> int:
    return int(max(least, -(-size // each)))


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with further columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def wrapped(df: DataFrame, **named) -> DataFrame:
    """The row as one struct ``doc`` beside the columns an operator works on: no name of the input can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), *[F.col(f"`{c}`").alias(name) for name, c in named.items()])
