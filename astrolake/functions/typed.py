"""Column types, their labels, and values from text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Source type -> (Spark type that holds it without loss, label).
SOURCE_TYPES = {
    "f32": (T.FloatType(), "f32"), "f64": (T.DoubleType(), "f64"),
    "i8": (T.ByteType(), "i8"), "i16": (T.ShortType(), "i16"), "i32": (T.IntegerType(), "i32"), "i64": (T.LongType(), "i64"),
    "u8": (T.ShortType(), "u8"), "u16": (T.IntegerType(), "u16"), "u32": (T.LongType(), "u32"), "u64": (T.DecimalType(20, 0), "u64"),
}

_LABELS = {"float": "f32", "double": "f64", "tinyint": "i8", "smallint": "i16", "int": "i32", "bigint": "i64", "decimal(20,0)": "u64"}


def type_label(field: T.StructField) -> str:
    """Label of a column: the source type where the metadata has one; vectors as ``label x n``."""
    kept = field.metadata.get("source_type")
    if isinstance(field.dataType, T.ArrayType):
        inner = _LABELS.get(field.dataType.elementType.simpleString(), field.dataType.elementType.simpleString())
        return f"{kept or inner}x{field.metadata.get('length', '?')}"
    return kept or _LABELS.get(field.dataType.simpleString(), field.dataType.simpleString())


def schema_table(df: DataFrame) -> DataFrame:
    """position, name, label, role of every column."""
    rows = [(i, f.name, type_label(f), f.metadata.get("role")) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, label string, role string")


def widened(df: DataFrame) -> DataFrame:
    """Numbers as SQL shows them: floats as double, integers as bigint (unsigned 64 bits stay decimals, so none wraps), vectors as null doubles; others stay."""

    def wide(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, T.IntegralType):
            return c.cast("bigint").alias(f.name)
        return F.lit(None).cast("double").alias(f.name) if isinstance(f.dataType, T.ArrayType) else c

    return df.select(*[wide(f) for f in df.schema.fields])


def parse(text: str, kind: T.DataType) -> Column:
    """A literal of a column's type from text; null where the text is no such value."""
    return F.lit(text).try_cast(kind)


def to_text(value: Column) -> Column:
    """A number as text with six significant digits, the way C prints it by default (%g)."""
    said = F.format_string("%.5e", F.abs(value.cast("double")))
    power = F.substring_index(said, "e", -1).cast("int")
    digits = F.replace(F.substring_index(said, "e", 1), F.lit("."), F.lit(""))
    large = F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.when(power >= 0, large).otherwise(small)
    split = F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))
    short = lambda c: F.regexp_replace(c, r"\.0*$|(\.[0-9]*[1-9])0+$", "$1")
    raised = F.concat(short(split), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    shown = F.when((power >= -4) & (power < 6), short(plain)).otherwise(raised)
    return F.when(value.isNull(), None).otherwise(F.concat(F.when(value.cast("double").cast("string").startswith("-"), "-").otherwise(""), shown))


def file_info(df: DataFrame, rank: str = "_rank", boxes: list[str] | None = None) -> DataFrame:
    """Totals of a table: rows, ranks, columns, the largest rank, and the extent of the given columns."""
    sizes = df.groupBy(rank).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in boxes or [] for k, f in (("min", F.min), ("max", F.max))])
    return sizes.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_ranks"), F.max("n").alias("max_rank_rows"), F.lit(len(df.columns)).alias("n_columns"), *[f(f"{k}_{c}").alias(f"{k}_{c}") for c in boxes or [] for k, f in (("min", F.min), ("max", F.max))])


def flatten_vector(df: DataFrame, column: str, length: int) -> DataFrame:
    """A vector column as scalar columns name.x .y .z .w .w1 ..."""
    names = [".x", ".y", ".z", ".w"][:length] + [f".w{i}" for i in range(1, length - 3)]
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*others, *[F.get(F.col(column), F.lit(i)).alias(f"{column}{n}") for i, n in enumerate(names)])


#: Fixed value: the reflected polynomial of ECMA-182.
_CRC_POLYNOMIAL = 0xC96C5795D7870F42


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        table = np.where(table & np.uint64(1), (table >> np.uint64(1)) ^ np.uint64(_CRC_POLYNOMIAL), table >> np.uint64(1))
    return table


def crc64_of(data: bytes) -> int:
    """CRC-64 (reflected ECMA-182 polynomial, inverted at both ends) of some bytes."""
    table, crc = _crc_table(), 0xFFFFFFFFFFFFFFFF
    for b in data:
        crc = int(table[(crc ^ b) & 0xFF]) ^ (crc >> 8)
    return crc ^ 0xFFFFFFFFFFFFFFFF


@F.pandas_udf(T.DecimalType(20, 0))
def crc64(values: pd.Series) -> pd.Series:
    """CRC-64 of binary values, a whole batch at a time: byte positions in step over all rows."""
    import decimal

    table = _crc_table()
    rows = [b"" if v is None else bytes(v) for v in values]
    length = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-length, kind="stable")
    crc = np.full(len(rows), 0xFFFFFFFFFFFFFFFF, np.uint64)
    offsets = np.r_[0, np.cumsum(length)]
    data = np.frombuffer(b"".join(rows), np.uint8)
    alive = np.searchsorted(-length[order], -np.arange(1, int(length.max(initial=0)) + 1), "right")
    for i, n in enumerate(alive.tolist()):
        at = order[:n]
        byte = data[offsets[at] + i].astype(np.uint64)
        crc[at] = table[((crc[at] ^ byte) & np.uint64(0xFF)).astype(np.int64)] ^ (crc[at] >> np.uint64(8))
    return pd.Series([decimal.Decimal(int(c)) for c in crc ^ np.uint64(0xFFFFFFFFFFFFFFFF)])
