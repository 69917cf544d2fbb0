"""Comparison of two tables as multisets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks, as often as it lacks them."""
    return a.exceptAll(b.select(*a.columns))


def identical(a: DataFrame, b: DataFrame) -> bool:
    return sorted(a.columns) == sorted(b.columns) and missing(a, b).isEmpty() and missing(b, a).isEmpty()


def row_counts(a: DataFrame, b: DataFrame, rank: str = "_rank") -> DataFrame:
    """Rows per rank in both tables and their difference."""
    x = a.groupBy(rank).agg(F.count(F.lit(1)).alias("n_a"))
    y = b.groupBy(rank).agg(F.count(F.lit(1)).alias("n_b"))
    both = x.join(y, rank, "full").select(rank, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return both.withColumn("difference", F.col("n_a") - F.col("n_b"))


def row_hash(columns: list[str]) -> Column:
    """A row's hash takes each column with its place and whether it is null, in order of names."""
    return F.xxhash64(*[c for i, name in enumerate(sorted(columns)) for c in (F.lit(i), F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))])


def digest(df: DataFrame, rank: str = "_rank") -> DataFrame:
    """Order-free digest of each rank's rows, to verify a copy against: count, sum and xor of row hashes."""
    h = row_hash(df.columns)
    return df.groupBy(rank).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h.cast("decimal(38,0)")).alias("sum_hash"), F.bit_xor(h).alias("xor_hash"))


def verify(expected: DataFrame, found: DataFrame, rank: str = "_rank") -> DataFrame:
    """Ranks whose digests differ or that only one side has."""
    e, f = expected.withColumnRenamed("n_rows", "n_e"), found.withColumnRenamed("n_rows", "n_f")
    joined = e.alias("e").join(f.alias("f"), rank, "full")
    same = F.col("n_e").eqNullSafe(F.col("n_f"))
    return joined.where(~(same & F.col("e.xor_hash").eqNullSafe(F.col("f.xor_hash")) & F.col("e.sum_hash").eqNullSafe(F.col("f.sum_hash")))).select(rank)
