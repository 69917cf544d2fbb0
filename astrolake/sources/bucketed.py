"""Tables stored in buckets of a key, compared without moving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.operators.compare import row_hash


#: Rows of a bucket, which one task sorts and compares.
BUCKET_ROWS = 1 << 18


def buckets_for(*tables: DataFrame, least: int = 8) -> int:
    """Buckets for tables that are to be compared: as many as the rows of the longest ask for."""
    return max(least, *[-(-t.count() // BUCKET_ROWS) for t in tables])


def write(df: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    """An external table of the session's catalog: one sorted file for each bucket of the key."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", path).saveAsTable(table)


def digests(df: DataFrame, key: str) -> DataFrame:
    """n_rows, sum_hash and xor_hash of the rows of each key."""
    h = row_hash(df.columns)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h.cast("decimal(38,0)")).alias("sum_hash"), F.bit_xor(h).alias("xor_hash"))


def differing_keys(spark: SparkSession, a: str, b: str, key: str) -> DataFrame:
    """(key, n_a, n_b) of the keys whose rows differ as multisets, in two tables of equal buckets of it.

    Both sides are grouped and joined bucket by bucket: neither has an exchange.  Rows of a
    null key are no key's rows."""
    x, y = (digests(spark.table(t).where(F.col(key).isNotNull()), key).alias(n) for t, n in ((a, "a"), (b, "b")))
    same = F.col("a.n_rows").eqNullSafe(F.col("b.n_rows")) & F.col("a.sum_hash").eqNullSafe(F.col("b.sum_hash")) & F.col("a.xor_hash").eqNullSafe(F.col("b.xor_hash"))
    joined = x.hint("merge").join(y, key, "full").where(~same)
    return joined.select(key, F.coalesce("a.n_rows", F.lit(0)).alias("n_a"), F.coalesce("b.n_rows", F.lit(0)).alias("n_b"))


def differing_rows(spark: SparkSession, a: str, b: str, key: str) -> DataFrame:
    """Rows that ``a`` has more often than ``b``: only those of keys that differ are compared."""
    keys = differing_keys(spark, a, b, key).select(key)
    x, y = (spark.table(t).join(keys, key, "left_semi") for t in (a, b))
    return x.exceptAll(y.select(*x.columns))
