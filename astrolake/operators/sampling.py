"""Exact samples per rank, and prefixes of shuffled leaves.

The random order of rows is that of the md5 of a seed and the row's key: the same in
any run, on any cluster, and in any engine.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolake.sources.shared import broadcast_if_few

LINEAR, CUBE = 1, 3
#: Leading hexadecimal digits of the shuffled order that make a cell.
CELL_DIGITS = 3
#: Groups whose last rows are held by the driver and broadcast.
BROADCAST_GROUPS = 1 << 16


def shuffle_key(key: str, seed: int = 0) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def first_shuffled(df: DataFrame, by: list[str], key: str, take, seed: int = 0) -> DataFrame:
    """The first ``take(n)`` rows of every group in shuffled order, n being its rows.

    Keys alone are counted per group and leading digits of their hash; running sums find the
    cell that holds the last row taken, and only the keys of that cell are sorted, to find the
    last hash and key of each group.  The rows are then filtered in one scan; none is moved.
    Up to ``BROADCAST_GROUPS`` groups' ends are taken to the driver and broadcast, more of
    them are joined as they are."""
    names = [f"_by{i}" for i in range(len(by))]
    keys = df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(key).alias("_key"), shuffle_key(key, seed).alias("_hash")).withColumn("_cell", F.substring("_hash", 1, CELL_DIGITS))
    cells = keys.groupBy(*names, "_cell").agg(F.count(F.lit(1)).alias("_count"))
    whole = Window.partitionBy(*names)
    cells = cells.withColumn("_upto", F.sum("_count").over(whole.orderBy("_cell"))).withColumn("_take", take(F.sum("_count").over(whole)).cast("long"))
    edges = cells.where((F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_count") < F.col("_take"))).withColumn("_left", F.col("_take") - F.col("_upto") + F.col("_count"))
    edges = edges.select(*[F.col(n).alias(f"{n}e") for n in names], F.col("_cell").alias("_edge"), "_left")

    def same(left: list[str], right: list[str]) -> Column:
        return reduce(and_, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])

    inside = keys.join(edges, same(names, [f"{n}e" for n in names]) & (F.col("_cell") == F.col("_edge")))
    placed = inside.withColumn("_k", F.row_number().over(whole.orderBy("_hash", "_key")))
    ends = placed.where("_k = _left").select(*names, F.col("_hash").alias("_last"), F.col("_key").alias("_last_key"))
    ends = broadcast_if_few(ends, BROADCAST_GROUPS)
    h = shuffle_key(key, seed)
    joined = df.join(ends, same([f"`{c}`" for c in by], names)).where((h < F.col("_last")) | ((h == F.col("_last")) & (F.col(key) <= F.col("_last_key"))))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns])


def sample(df: DataFrame, share: float, key: str, rank: str = "_rank", power: int = CUBE, seed: int = 0) -> DataFrame:
    """Exactly round(n * share**power) rows of every rank, without replacement."""
    return first_shuffled(df, [rank], key, lambda n: F.round(n * F.lit(float(share) ** power)), seed)


def sample_then(df: DataFrame, share: float, key: str, condition: Column, **options) -> DataFrame:
    """The condition applies to the sampled rows only; it is not moved below the sample."""
    return sample(df, share, key, **options).where(condition)


def leaf_prefix(df: DataFrame, share: float, key: str, leaf: list[str], seed: int = 0) -> DataFrame:
    """First trunc(n * share) rows of every leaf, whose rows stand in shuffled order."""
    return first_shuffled(df, leaf, key, lambda n: F.floor(n * F.lit(float(share))), seed)
