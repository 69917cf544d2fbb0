"""Text and row-major exports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.functions.typed import type_label
from astrolake.model import numbered

#: Fields of a row-major particle record, in order.
ROW_MAJOR = (("x", "<f4"), ("vx", "<f4"), ("y", "<f4"), ("vy", "<f4"), ("z", "<f4"), ("vz", "<f4"), ("phi", "<f4"), ("id", "<i8"))

BLOCK_ROWS = 1 << 16


def header_lines(df: DataFrame) -> list[str]:
    """Two comment lines: names, and types."""
    return ["# " + "\t".join(df.columns), "# " + "\t".join(f"({type_label(f)})" for f in df.schema.fields)]


def table_lines(df: DataFrame) -> DataFrame:
    """Rows as tab-separated text."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated files with the two header lines in a file that sorts first."""
    spark = df.sparkSession
    spark.createDataFrame([("\n".join(header_lines(df)),)], "value string").coalesce(1).write.text(f"{path}/_header")
    table_lines(df).write.text(f"{path}/rows")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def row_major(df: DataFrame, rank: str = "_rank", order: tuple[str, ...] = ("id",), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Packed records of each rank in order: (_rank, block, n_rows, data); blocks count from 0 in every rank."""
    kind = np.dtype([(n, t) for n, t in ROW_MAJOR])
    rows = numbered(df, [rank], order, "_position", "_rank_rows")
    rows = rows.select(F.col(rank).cast("int").alias("_rank"), F.floor(F.col("_position") / block_rows).cast("int").alias("block"), "_position", *[F.col(n).cast("bigint" if t == "<i8" else "float") for n, t in ROW_MAJOR])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_position")
        packed = np.zeros(table.num_rows, kind)
        for n, _ in ROW_MAJOR:
            packed[n] = table.column(n).to_numpy()
        return pa.table({"_rank": table.column("_rank")[:1], "block": table.column("block")[:1], "n_rows": pa.array([table.num_rows], pa.int64()), "data": pa.array([packed.tobytes()], pa.binary())})

    return rows.groupBy("_rank", "block").applyInArrow(run, "_rank int, block int, n_rows long, data binary")


def write_row_major(df: DataFrame, path: str, **options) -> None:
    """The records as a table with a directory per rank, blocks in order."""
    row_major(df, **options).repartition("_rank").sortWithinPartitions("_rank", "block").write.partitionBy("_rank").parquet(path)


def read_row_major(spark: SparkSession, path: str) -> DataFrame:
    """The particles of stored records, with their rank and their place in it (from 0)."""
    kind = np.dtype([(n, t) for n, t in ROW_MAJOR])
    blocks = spark.read.parquet(path).select(F.col("_rank").cast("int").alias("_rank"), F.col("block").cast("long").alias("block"), "data")

    def run(batches):
        for batch in batches:
            for r, b, data in zip(*(batch.column(c).to_pylist() for c in ("_rank", "block", "data")), strict=True):
                rows = np.frombuffer(data, kind)
                columns = [pa.array(np.ascontiguousarray(rows[n])) for n, _ in ROW_MAJOR]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r] * len(rows), pa.int32()), pa.array([b] * len(rows), pa.int64()), pa.array(np.arange(len(rows)), pa.int64())], names=[*(n for n, _ in ROW_MAJOR), "_rank", "_block", "_in_block"])

    shown = ", ".join(f"{n} {'bigint' if t == '<i8' else 'float'}" for n, t in ROW_MAJOR)
    return blocks.mapInArrow(run, f"{shown}, _rank int, _block long, _in_block long")
