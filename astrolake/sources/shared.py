"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small side of a join that the driver may hold and broadcast.
FEW = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, one in the warehouse, if executors can see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_intermediate"
        if folder.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("executors do not share this machine's folders: set spark.checkpoint.dir to one that they do")
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def drop(spark: SparkSession, made: list[str]) -> None:
    """Delete what ``written`` has put into the shared folder."""
    for path in made:
        files, at = _file_system(spark, path)
        files.delete(at, True)
    made.clear()


def written(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and lost executors lose nothing.

    The path is added to ``made``, for ``drop`` once what follows from it is written as well."""
    spark = df.sparkSession
    path, schema = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.option("compression", "zstd").parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(schema).parquet(path)


def broadcast_if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` taken to the driver and broadcast if it has ``most`` rows or fewer; else ``df`` as it is."""
    few = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(few, df.schema)) if len(few) <= most else df
