"""Assignments of ranks to readers, rank regions, partition maps."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.model import Dataset


def blocks_tail(rank: Column, n_ranks: int, readers: int) -> Column:
    """Contiguous blocks; the last readers take one more where it does not divide, and only they read where ranks are few."""
    base, more = divmod(n_ranks, readers)
    first = (readers - more) * base
    late = F.lit(readers - more) + F.floor((rank - first) / (base + 1))
    return (F.when(rank < first, F.floor(rank / max(base, 1))).otherwise(late)).cast("int")


def blocks_head(rank: Column, n_ranks: int, readers: int) -> Column:
    """Contiguous blocks; the first readers take one more where it does not divide."""
    base, more = divmod(n_ranks, readers)
    first = more * (base + 1)
    early = F.floor(rank / (base + 1))
    return (F.when(rank < first, early).otherwise(F.lit(more) + F.floor((rank - first) / max(base, 1)))).cast("int")


def blocks_last(rank: Column, n_ranks: int, readers: int) -> Column:
    """n / readers each; the last reader takes the rest."""
    return F.least(F.floor(rank / max(n_ranks // readers, 1)), F.lit(readers - 1)).cast("int")


def regions(ranks: DataFrame, origin: float = 0.0, scale: float = 256.0, parts: int = 2) -> DataFrame:
    """Physical box of each rank of a parts**3 grid, from _cx, _cy, _cz."""
    for axis, c in zip("xyz", ("_cx", "_cy", "_cz"), strict=True):
        ranks = ranks.withColumn(f"min_{axis}", F.col(c) / F.lit(float(parts)) * scale + origin).withColumn(f"max_{axis}", (F.col(c) + 1) / F.lit(float(parts)) * scale + origin)
    return ranks


def natural_partition(host: Column, rank: Column | None = None, per_host: int = 1) -> Column:
    """Bucket of a writer by the bytes of its host's name, modulo 256, and by its rank among ``per_host``."""
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(host), F.lit(1))), lambda i: F.ascii(F.substr(host, i, F.lit(1)))), F.lit(0), lambda a, b: a + b)
    bucket = F.pmod(total, F.lit(256))
    return (bucket if rank is None else bucket * per_host + F.pmod(rank, F.lit(per_host))).cast("int")


def reshard(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """As many partitions as asked for; contiguous by key if one is given."""
    return df.repartitionByRange(n, *keys) if keys else df.repartition(n)


def reranked(data: Dataset, n_ranks: int, n: int) -> Dataset:
    """The table dealt to ``n`` ranks instead of ``n_ranks``: each takes neighbouring ranks whole, and the last ones one more where it does not divide.

    Where the number changes, ranks are no longer boxes in space, so the roles of columns go."""
    if n == n_ranks:
        return data
    df = data.df.withColumn("_source_rank", F.col(data.rank)).withColumn(data.rank, blocks_tail(F.col(data.rank), n_ranks, n))
    return replace(data, df=df, order=("_source_rank", *data.order), roles={})
