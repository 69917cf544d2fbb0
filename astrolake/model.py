"""Tables of particles: columns with coordinate roles, ranks, and a physical box."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolake.sources.shared import broadcast_if_few, written

#: Rows of a group that one task may sort, and rows of a range where a group has more.
WINDOW_ROWS, CELL_ROWS = 1 << 23, 1 << 21


def infer_roles(columns: list[str]) -> dict[str, str]:
    """Coordinate columns: the first whose name holds _x, _y, _z; unless all are found, those named x, y, z."""
    found = {axis: next((c for c in columns if f"_{axis}" in c), None) for axis in "xyz"}
    if not all(found.values()):
        found = {axis: axis if axis in columns else None for axis in "xyz"}
    return {axis: c for axis, c in found.items() if c}


@dataclass(frozen=True)
class Dataset:
    """A DataFrame with the roles of its columns, inferred from their names where none are given.

    ``rank`` names the horizontal partition, ``order`` the columns that fix the order
    of rows inside one.  Positions need a window per rank; a table that is read often
    should be stored with them (``sources.ranked.write``), so that later reads are
    scans with filters that Parquet can push down.
    """

    df: DataFrame
    rank: str = "_rank"
    order: tuple[str, ...] = ("id",)
    roles: dict[str, str] | None = None
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    scale: tuple[float, float, float] = (256.0, 256.0, 256.0)

    def __post_init__(self):
        if self.roles is None:
            object.__setattr__(self, "roles", infer_roles(self.df.columns))

    def with_df(self, df: DataFrame) -> Dataset:
        return replace(self, df=df)

    def axis(self, name: str) -> Column:
        return F.col(self.roles[name]).cast("double")

    def ranks(self) -> DataFrame:
        """_rank, n_rows, rank_offset (rows of smaller ranks): one row per rank."""
        counts = self.df.groupBy(F.col(self.rank).alias("_rank")).agg(F.count(F.lit(1)).alias("n_rows"))
        before = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("rank_offset", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).cast("long"))

    def points(self, *columns: str) -> DataFrame:
        """One vertex per row: ``point`` from the role columns as floats, and further columns."""
        return self.df.select(F.struct(*[F.col(f"`{self.roles[a]}`").cast("float").alias(a) for a in "xyz"]).alias("point"), *[F.col(f"`{c}`") for c in columns])

    def rows_to_show(self, share: float) -> DataFrame:
        """Rows of every rank that a share of the table shows."""
        return self.ranks().select("_rank", F.floor(F.col("n_rows") * F.lit(float(share))).cast("long").alias("n_shown"))

    def total_rows(self) -> int:
        """Exact also for tables in several files."""
        return self.df.count()

    def extended(self, leaf: str | None = None) -> DataFrame:
        """The table with its hidden columns: _row_in_rank, _rank_rows, _percent (in the rank, or in the leaf), _rowid.

        The row id counts from 1 over ranks in order: a prefix sum over the few rows of
        ``ranks`` is joined to positions inside the ranks, so nothing is ordered globally
        and the id of a row does not depend on later filters.
        """
        rows = numbered(self.df, [self.rank], self.order, "_row_in_rank", "_rank_rows")
        ranks = self.ranks().select(F.col("_rank").alias("_r"), "rank_offset")
        rows = rows.join(broadcast_if_few(ranks), F.col(self.rank).eqNullSafe(F.col("_r"))).drop("_r")
        rows = rows.withColumn("_rowid", F.col("rank_offset") + F.col("_row_in_rank") + 1).drop("rank_offset")
        if leaf is None:
            return rows.withColumn("_percent", F.col("_row_in_rank") / F.col("_rank_rows"))
        rows = numbered(rows, [self.rank, leaf], self.order, "_row_in_leaf", "_leaf_rows")
        return rows.withColumn("_percent", F.col("_row_in_leaf") / F.col("_leaf_rows")).drop("_row_in_leaf", "_leaf_rows")


def numbered(df: DataFrame, keys: list[str], order: tuple[str, ...], position: str, total: str, most: int = WINDOW_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows with their position (from 0) inside their group and the group's number of rows.

    Groups of up to ``most`` rows are sorted by a window.  If there is a larger one, rows
    are dealt to ranges of (keys, order) and sorted inside of them; the rows of each group
    in each range are counted, and running sums over the ranges are added to the places
    inside them, so no task sorts a whole group.  The ranges are written first, because both
    the counts and the rows must come from the same ones."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(total))
    n_rows, largest = sizes.agg(F.sum(total), F.max(total)).first()
    names = [f"_key{i}" for i in range(len(keys))]
    if (largest or 0) <= most:
        inside = Window.partitionBy(*keys)
        return df.withColumn(position, (F.row_number().over(inside.orderBy(*order)) - 1).cast("long")).withColumn(total, F.count(F.lit(1)).over(inside))
    ranged = df.repartitionByRange(max(1, -(-n_rows // cell_rows)), *keys, *order).sortWithinPartitions(*keys, *order)
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()), "ranges")
    cells = ranged.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_count"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*names)
    before = whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn(total, F.sum("_count").over(whole)).withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0))).drop("_count")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]) & (F.col("_range") == F.col("_of"))
    return ranged.join(cells, same).withColumn(position, F.col("_before") + F.col("_at") - F.col("_first")).drop(*names, "_of", "_before", "_first", "_at", "_range")


def percent_slice(df: DataFrame, low: float | None = None, high: float | None = None, low_open: bool = False, high_open: bool = True) -> DataFrame:
    """Rows by ``_percent``; several bounds tighten each other, an empty range reads nothing."""
    low, high = (0.0 if low is None else low), (1.0 if high is None else high)
    if low > high or high < 0 or low > 1:
        return df.where(F.lit(False))
    p = F.col("_percent")
    return df.where((p > low if low_open else p >= low) & (p < high if high_open else p <= high))
