"""Leaves of bounded size: an octree that is deeper where rows are denser.

Rows are counted once in cells of the finest grid.  Cells are summed up level by level; a
node with more than ``most_rows`` rows is cut, so the leaves are the nodes that fit below
nodes that do not.  Each leaf is a range of Morton codes: the leaves in order of
``_first`` are a linear octree, a sorted list of cuts.  Rows find their leaf by an equality
of (level, code) at the levels that leaves are on; a row has one cell at each level and is
in one leaf.

Defined cases: positions outside of the grid belong to the outermost cells, null and nan
coordinates to those at the origin; a cell of the finest level is a leaf however many rows it has (equal
positions cannot be told apart); an empty table has no leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.operators.octree import cell, demorton, morton

DEPTH = 10
#: Leaves that rows meet by a broadcast; more of them are joined by a shuffle.
BROADCAST_LEAVES = 1 << 16


def fine_code(axes: list[Column], depth: int = DEPTH, origin: float = 0.0, scale: float = 256.0) -> Column:
    """Morton code of the cell of the finest level."""
    numbers = [F.coalesce(F.when(~F.isnan(p.cast("double")), cell(p.cast("double"), F.lit(float(origin)), F.lit(scale / (1 << depth)), 1 << depth)), F.lit(0).cast("long")) for p in axes]
    return morton(*numbers, depth)


def nodes(counts: DataFrame, depth: int) -> DataFrame:
    """(_level, _code, n_rows) of all occupied nodes, from (_code, n_rows) of the finest cells."""
    levels = F.array(*[F.struct(F.lit(n).alias("_level"), F.shiftright("_code", 3 * (depth - n)).alias("_code")) for n in range(depth + 1)])
    return counts.select(F.explode(levels).alias("_at"), "n_rows").groupBy("_at._level", "_at._code").agg(F.sum("n_rows").alias("n_rows"))


def adaptive_leaves(df: DataFrame, axes: list[Column], most_rows: int, depth: int = DEPTH, origin: float = 0.0, scale: float = 256.0) -> DataFrame:
    """_level, _code, _first, _last (codes of the finest level), n_rows and box of every leaf; at most ``most_rows`` rows each above the finest level."""
    counts = df.select(fine_code(axes, depth, origin, scale).alias("_code")).groupBy("_code").agg(F.count(F.lit(1)).alias("n_rows"))
    found = nodes(counts, depth)
    cut = found.where((F.col("n_rows") > most_rows) & (F.col("_level") < depth)).select((F.col("_level") + 1).alias("_below"), F.col("_code").alias("_parent"))
    whole = found.where((F.col("n_rows") <= most_rows) | (F.col("_level") == depth))
    below = whole.join(cut, (F.col("_level") == F.col("_below")) & (F.shiftright("_code", 3) == F.col("_parent")), "left_semi")
    leaves = below.unionByName(whole.where("_level = 0"))
    return with_boxes(leaves, depth, origin, scale)


def with_boxes(leaves: DataFrame, depth: int, origin: float, scale: float) -> DataFrame:
    rest = F.lit(3) * (F.lit(depth) - F.col("_level"))
    first = F.call_function("shiftleft", F.col("_code"), rest)
    leaves = leaves.withColumn("_first", first).withColumn("_last", F.call_function("shiftleft", F.col("_code") + 1, rest) - 1)
    width = F.lit(float(scale)) / F.pow(F.lit(2.0), F.col("_level"))
    for axis, number in zip("xyz", demorton(F.col("_code"), depth), strict=True):
        low = F.lit(float(origin)) + number * width
        leaves = leaves.withColumn(f"min_{axis}", low).withColumn(f"max_{axis}", low + width)
    return leaves


def assign(df: DataFrame, axes: list[Column], leaves: DataFrame, depth: int = DEPTH, origin: float = 0.0, scale: float = 256.0, broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """Rows with ``_level``, ``_code`` and ``_first`` of their leaf."""
    counts = {r["_level"]: r["n"] for r in leaves.groupBy("_level").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = sum(counts.values()) <= broadcast_leaves
    keys = F.array(*[F.struct(F.lit(n).alias("_level"), F.shiftright("_fine", 3 * (depth - n)).alias("_code")) for n in sorted(counts) or [0]])
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), fine_code(axes, depth, origin, scale).alias("_fine"))
    rows = rows.select("row", F.explode(keys).alias("_at")).select("row", "_at._level", "_at._code")
    cuts = leaves.select("_level", "_code", "_first")
    return rows.join(F.broadcast(cuts) if few else cuts, ["_level", "_code"]).select("row.*", "_level", "_code", "_first")
