"""CRC-64 of columns, made of CRCs of pieces.

Without the inversions at both ends a CRC is linear over GF(2): that of ``a`` followed by
``b`` is that of ``a``, moved on by the length of ``b`` in zero bytes, xor that of ``b``.
Moving on by one byte is a 64 x 64 matrix of bits; its squares move on by 2, 4, 8 ... bytes.
So a task joins the bytes of its rows by halves, pieces of tasks are joined in order of
their rows, and no task reads a whole column.
"""

from __future__ import annotations

import decimal
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.functions.typed import _crc_table

ONES = 0xFFFFFFFFFFFFFFFF
#: Pieces of a rank that one task joins at a time.
FAN = 1 << 14


def _applied(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A matrix, as eight tables of 256 words, times many CRCs."""
    out = np.zeros(len(crc), np.uint64)
    for i in range(8):
        out ^= tables[i][((crc >> np.uint64(8 * i)) & np.uint64(0xFF)).astype(np.int64)]
    return out


@cache
def moved_on(power: int) -> np.ndarray:
    """Tables of the matrix that moves a CRC on by 2**power zero bytes."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    if power == 0:
        columns = _crc_table()[(bits & np.uint64(0xFF)).astype(np.int64)] ^ (bits >> np.uint64(8))
    else:
        half = moved_on(power - 1)
        columns = _applied(half, _applied(half, bits))
    byte, tables = np.arange(256), np.zeros((8, 256), np.uint64)
    for i in range(8):
        for b in range(8):
            tables[i] ^= np.where((byte >> b) & 1, columns[8 * i + b], np.uint64(0))
    return tables


def after(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC moved on by its number of zero bytes."""
    crc, n_bytes, power = crc.copy(), n_bytes.astype(np.int64), 0
    while n_bytes.any():
        odd = (n_bytes & 1) == 1
        crc[odd] = _applied(moved_on(power), crc[odd])
        n_bytes, power = n_bytes >> 1, power + 1
    return crc


def piece(data: np.ndarray) -> int:
    """Linear CRC of bytes, by halves; zeros in front change nothing."""
    if not len(data):
        return 0
    size = 1 << (len(data) - 1).bit_length()
    crc = _crc_table()[np.r_[np.zeros(size - len(data), np.uint8), data]]
    power = 0
    while len(crc) > 1:
        crc, power = _applied(moved_on(power), crc[::2]) ^ crc[1::2], power + 1
    return int(crc[0])


def joined(crc: np.ndarray, n_bytes: np.ndarray) -> tuple[int, int]:
    """Linear CRC and length of pieces in order."""
    crc, n_bytes = crc.astype(np.uint64), n_bytes.astype(np.int64)
    while len(crc) > 1:
        if len(crc) % 2:
            crc, n_bytes = np.r_[np.zeros(1, np.uint64), crc], np.r_[np.zeros(1, np.int64), n_bytes]
        crc, n_bytes = after(crc[::2], n_bytes[1::2]) ^ crc[1::2], n_bytes[::2] + n_bytes[1::2]
    return (int(crc[0]), int(n_bytes[0])) if len(crc) else (0, 0)


def finished(crc: int, n_bytes: int) -> int:
    """The CRC-64 as it is written: inverted at both ends."""
    return int(after(np.array([ONES], np.uint64), np.array([n_bytes]))[0]) ^ crc ^ ONES


def value_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after the other (numbers little-endian, texts as UTF-8, nulls none), and where each starts."""
    valid = np.asarray(column.is_valid())
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        texts = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
        return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    if pa.types.is_temporal(column.type):
        column = column.cast(pa.int64()) if column.type.bit_width == 64 else column.cast(pa.int32())
    values = column.drop_null().to_numpy(zero_copy_only=False)
    values = np.ascontiguousarray(values.astype(values.dtype.newbyteorder("<")))
    return values.view(np.uint8), np.r_[0, np.cumsum(valid * values.dtype.itemsize)].astype(np.int64)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.decimal128(20, 0)]
    rows = [(*r[:4], decimal.Decimal(r[4])) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["_rank", "first_row", "n_rows", "n_bytes", "crc"])


PIECES = "_rank long, first_row long, n_rows long, n_bytes long, crc decimal(20,0)"


def _in_runs(rank: np.ndarray, first: np.ndarray, n: np.ndarray):
    """Slices of pieces, in order of rank and row, that follow each other without a gap."""
    new = np.r_[True, (rank[1:] != rank[:-1]) | (first[1:] != first[:-1] + n[:-1])] if len(rank) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return zip(at.tolist(), np.r_[at[1:], len(rank)].tolist(), strict=True)


def pieces(rows: DataFrame, column: str, rank: str = "_rank", position: str = "_row_in_rank") -> DataFrame:
    """Linear CRCs of runs of rows, as they stand in the tasks: nothing is shuffled, and any order of rows will do."""

    def run(batches):
        for batch in batches:
            ranks, places = batch.column("r").to_numpy(), batch.column("p").to_numpy()
            order = np.lexsort((places, ranks))
            data, starts = value_bytes(batch.column("v").take(pa.array(order)))
            ranks, places = ranks[order], places[order]
            yield _table([(int(ranks[a]), int(places[a]), b - a, int(starts[b] - starts[a]), piece(data[starts[a] : starts[b]])) for a, b in _in_runs(ranks, places, np.ones(len(ranks), np.int64))])

    return rows.select(F.col(rank).cast("long").alias("r"), F.col(position).cast("long").alias("p"), F.col(f"`{column}`").alias("v")).mapInArrow(run, PIECES)


def combined(found: DataFrame, *keys) -> DataFrame:
    """Pieces of each group joined where they follow each other."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("first_row").to_numpy(), table.column("_rank").to_numpy()))
        table = table.take(pa.array(order))
        rank, first, n, size = (table.column(c).to_numpy() for c in ("_rank", "first_row", "n_rows", "n_bytes"))
        crc = np.array([int(x) for x in table.column("crc").to_pylist()], np.uint64)
        out = []
        for a, b in _in_runs(rank, first, n):
            whole, length = joined(crc[a:b], size[a:b])
            out.append((int(rank[a]), int(first[a]), int(n[a:b].sum()), length, whole))
        return pa.Table.from_batches([_table(out)])

    return found.groupBy(*keys).applyInArrow(run, PIECES)


def column_crc(rows: DataFrame, column: str, rank: str = "_rank", position: str = "_row_in_rank", fan: int = FAN) -> DataFrame:
    """(_rank, n_rows, n_bytes, crc): CRC-64 of each rank's column, bytes in order of position (from 0, without gaps), on any partitioning.

    Pieces of ``fan`` rows times the rows of an Arrow batch are joined first, then those of a rank."""
    found = pieces(rows, column, rank, position)
    near = combined(found, "_rank", F.floor(F.col("first_row") / (fan * 1000)).cast("long"))
    whole = combined(near, "_rank")

    @F.pandas_udf("decimal(20,0)")
    def finish(crc, n_bytes):
        import pandas as pd

        return pd.Series([decimal.Decimal(finished(int(c), int(n))) for c, n in zip(crc, n_bytes, strict=True)])

    return whole.select("_rank", "n_rows", "n_bytes", finish("crc", "n_bytes").alias("crc"))
