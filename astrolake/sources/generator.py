"""A synthetic particle box: eight ranks, or as many as asked for, on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.model import Dataset


def particles(spark: SparkSession, per_rank: int = 1000, parts: int = 2, cell: float = 128.0, seed: int = 989) -> Dataset:
    """x y z (hundredths inside the rank's cell), vx vy vz, phi, id, mask (the rank); columns are hashes of the id."""

    def drawn(what: str, n: int):
        return F.pmod(F.xxhash64(F.col("id"), F.lit(what), F.lit(seed)), F.lit(n))

    df = spark.range(per_rank * parts**3).withColumn("_rank", F.floor(F.col("id") / per_rank).cast("int"))
    for axis, d in (("x", parts * parts), ("y", parts), ("z", 1)):
        df = df.withColumn(axis, (drawn(axis, int(cell * 100)) / 100 + F.pmod(F.floor(F.col("_rank") / d), F.lit(parts)) * cell).cast("float"))
    for v in ("vx", "vy", "vz"):
        df = df.withColumn(v, (drawn(v, 1000) / 1000).cast("float"))
    df = df.withColumn("phi", (drawn("phi", 1000) / 100).cast("float")).withColumn("mask", F.col("_rank"))
    return Dataset(df, scale=(cell * parts,) * 3)


def summary(df: DataFrame) -> DataFrame:
    """Largest coordinates and rows."""
    return df.agg(F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.max("z").alias("max_z"), F.count(F.lit(1)).alias("n_rows"))
