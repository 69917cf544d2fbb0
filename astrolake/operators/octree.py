"""Spatial leaves of each rank's box, as column expressions.

With L levels a rank has 8**(L-1) leaves.  Boxes are halved in turn along x, y, z, the
first cut being the most significant, so a leaf's number is a Morton code of the cell
numbers with bits in the order x, y, z from the top: no search and no join.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(p: Column, low: Column, width: Column, parts: int) -> Column:
    """Number of the half-open cell along one axis; positions outside go to the nearest."""
    return F.least(F.greatest(F.floor((p - low) / width), F.lit(0)), F.lit(parts - 1)).cast("long")


def morton(x: Column, y: Column, z: Column, bits: int) -> Column:
    """Bits of three cell numbers, interleaved from the top in the order x, y, z."""
    terms = []
    for b in range(bits):
        for axis, shift in ((x, 2), (y, 1), (z, 0)):
            terms.append(F.shiftleft(F.shiftright(axis, b).bitwiseAND(F.lit(1).cast("long")), 3 * b + shift))
    return reduce(lambda a, c: a.bitwiseOR(c), terms) if terms else F.lit(0).cast("long")


def demorton(leaf: Column, bits: int) -> tuple[Column, Column, Column]:
    """Cell numbers of a Morton code."""

    def axis(shift):
        terms = [F.shiftleft(F.shiftright(leaf, 3 * b + shift).bitwiseAND(F.lit(1).cast("long")), b) for b in range(bits)]
        return reduce(lambda a, c: a.bitwiseOR(c), terms) if terms else F.lit(0).cast("long")

    return axis(2), axis(1), axis(0)


def wrap(p: Column, low: Column, high: Column, origin: float, end: float) -> Column:
    """Positions on the face of the periodic box, seen from the rank on the other side."""
    return F.when((p == origin) & (high == end) & (low > origin), F.lit(float(end))).when((p == end) & (low == origin) & (high < end), F.lit(float(origin))).otherwise(p)


def rank_grid(df: DataFrame, axes: list[Column], origin: float = 0.0, scale: float = 256.0, parts: int = 2) -> DataFrame:
    """Ranks of a parts**3 grid over the box: _rank and the cell numbers _cx, _cy, _cz."""
    width = scale / parts
    for name, p in zip(("_cx", "_cy", "_cz"), axes, strict=True):
        df = df.withColumn(name, cell(p, F.lit(origin), F.lit(width), parts).cast("int"))
    return df.withColumn("_rank", (F.col("_cx") * parts * parts + F.col("_cy") * parts + F.col("_cz")).cast("int"))


def assign_leaf(df: DataFrame, axes: list[Column], levels: int, origin: float = 0.0, scale: float = 256.0, parts: int = 2) -> DataFrame:
    """Adds ``_leaf``, the number inside the rank, and ``_leaf_id``, the number over all ranks."""
    if levels < 2:
        raise ValueError("an octree needs two levels")
    per_axis = 1 << (levels - 1)
    width, leaf_width = scale / parts, scale / parts / per_axis
    cells = []
    for name, p in zip(("_cx", "_cy", "_cz"), axes, strict=True):
        low = F.lit(origin) + F.col(name) * F.lit(width)
        cells.append(cell(wrap(p, low, low + width, origin, origin + scale), low, F.lit(leaf_width), per_axis))
    df = df.withColumn("_leaf", morton(*cells, bits=levels - 1))
    return df.withColumn("_leaf_id", F.col("_rank").cast("long") * F.lit(8 ** (levels - 1)).cast("long") + F.col("_leaf"))


def leaf_boxes(df: DataFrame, levels: int, origin: float = 0.0, scale: float = 256.0, parts: int = 2) -> DataFrame:
    """min_x .. max_z of the leaf of every row, from _leaf and the rank's cell numbers."""
    width = scale / parts
    leaf_width = width / (1 << (levels - 1))
    for axis, base, number in zip("xyz", ("_cx", "_cy", "_cz"), demorton(F.col("_leaf").cast("long"), levels - 1), strict=True):
        low = F.lit(origin) + F.col(base) * F.lit(width) + number * F.lit(leaf_width)
        df = df.withColumn(f"min_{axis}", low).withColumn(f"max_{axis}", low + leaf_width)
    return df


def leaf_table(df: DataFrame, levels: int, **box) -> DataFrame:
    """One row per occupied leaf: _leaf_id, _rank, _leaf, box, n_rows, row_offset (rows of smaller leaves in its rank)."""
    counts = df.groupBy("_leaf_id", "_rank", "_leaf", "_cx", "_cy", "_cz").agg(F.count(F.lit(1)).alias("n_rows"))
    before = Window.partitionBy("_rank").orderBy("_leaf").rowsBetween(Window.unboundedPreceding, -1)
    return leaf_boxes(counts, levels, **box).withColumn("row_offset", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).cast("long")).drop("_cx", "_cy", "_cz")


def integer_boxes(leaves: DataFrame) -> DataFrame:
    """Boxes rounded to integers, as the compact leaf table stores them."""
    for c in ("min_x", "max_x", "min_y", "max_y", "min_z", "max_z"):
        leaves = leaves.withColumn(c, F.round(c).cast("long"))
    return leaves


def touches(region: tuple[float, float, float, float, float, float]) -> Column:
    """Leaf and region (x0, x1, y0, y1, z0, z1) meet; a region that starts on a leaf's end does not, one that ends on its start does."""
    return reduce(and_, [(F.lit(float(region[2 * i])) < F.col(f"max_{a}")) & (F.lit(float(region[2 * i + 1])) >= F.col(f"min_{a}")) for i, a in enumerate("xyz")])


def region_leaves(leaves: DataFrame, region) -> DataFrame:
    """Leaves that a region touches."""
    return leaves.where(touches(region))


def region_rows(df: DataFrame, axes: list[Column], region, closed: bool = True) -> DataFrame:
    """Rows in the region.  On data stored by leaf the comparisons reach the Parquet row groups' minima and maxima."""
    tests = [(p >= float(region[2 * i])) & ((p <= float(region[2 * i + 1])) if closed else (p < float(region[2 * i + 1]))) for i, p in enumerate(axes)]
    return df.where(reduce(and_, tests))


def violations(df: DataFrame, axes: list[Column], levels: int, **box) -> DataFrame:
    """Rows outside the closed box of their own leaf: none, if leaves are right."""
    boxed = leaf_boxes(df, levels, **box)
    return boxed.where(reduce(or_, [(p < F.col(f"min_{a}")) | (p > F.col(f"max_{a}")) for a, p in zip("xyz", axes, strict=True)]))


def leaf_text(leaves: DataFrame) -> DataFrame:
    """A line of text per leaf."""
    return leaves.select("_leaf_id", F.format_string("%d : %.1f - %.1f, %.1f - %.1f, %.1f - %.1f : %d rows from %d, rank %d", "_leaf_id", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z", "n_rows", "row_offset", "_rank").alias("line"))


def clustered(df: DataFrame, key: str, n_files: int, seed: int = 0) -> DataFrame:
    """Rows by leaf, shuffled inside a leaf: contiguous leaves per file, so that leaf and box filters skip row groups."""
    from astrolake.operators.sampling import shuffle_key

    return df.withColumn("_shuffle", shuffle_key(key, seed)).repartitionByRange(n_files, "_leaf_id", "_shuffle").sortWithinPartitions("_leaf_id", "_shuffle").drop("_shuffle")
