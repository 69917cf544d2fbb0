"""Stored octrees that grow by runs.

Rows are stored as runs: directories ``run``, ``_cell`` (leading bits of the leaf number),
sorted by leaf and shuffled inside of it.  Appending writes one more run; compaction merges
the runs of the cells that have too many into a new one and leaves the other files as they
are.  What is live stands in a manifest, a table of parts (run, cell, leaf: rows, extent):
the leaf table and its offsets are sums over it, so they are merged without reading rows.

Each change writes a new manifest and then creates the file of the next version, which
fails if someone else has done so: readers see the old table or the new one, and of two
writers at a time one has to try again.  Directories that no manifest names are not read;
``vacuum`` deletes them, once no reader of an older version is left.

Defined cases: appended rows need the columns of the table; repeated rows stay; a run of no
rows adds nothing; a cell of any size is written by as many tasks as its rows ask for.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrolake.model import Dataset, numbered
from astrolake.operators.sampling import shuffle_key
from astrolake.sources.shared import _file_system

#: Rows that one task of a run sorts and writes.
FILE_ROWS = 1 << 20
#: Live cells that a read picks by a broadcast; more of them are picked by a shuffle.
BROADCAST_CELLS = 1 << 16


class Conflict(RuntimeError):
    """Another writer made this version."""


def _create(spark: SparkSession, path: str, text: str) -> None:
    files, at = _file_system(spark, path)
    try:
        out = files.create(at, False)
    except Exception as e:
        if files.exists(at):
            raise Conflict(path) from e
        raise
    out.writeBytes(text)
    out.close()


def _versions(spark: SparkSession, path: str) -> list[str]:
    files, at = _file_system(spark, f"{path}/_versions")
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def _state(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and settings of the newest version."""
    last = _versions(spark, path)[-1]
    return int(last), json.loads(spark.read.text(f"{path}/_versions/{last}").first()["value"])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """run, _cell, _rank, _leaf_id, n_rows, min_x .. max_z of all live parts."""
    return spark.read.parquet(f"{path}/_manifests/{_state(spark, path)[1]['manifest']}")


def _run(spark: SparkSession, path: str, rows: DataFrame, told: dict) -> DataFrame:
    """Rows written as a new run, and its parts."""
    name, key = f"r{uuid.uuid4().hex}", told["key"]
    rows = rows.withColumn("_cell", F.shiftright(F.col("_leaf_id").cast("long"), told["shift"])).withColumn("_shuffle", shuffle_key(key))
    order = ["_cell", "_leaf_id", "_shuffle", key]
    n = max(1, -(-rows.count() // told["file_rows"]))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_shuffle")
    rows.write.partitionBy("_cell").option("compression", "zstd").parquet(f"{path}/runs/run={name}")
    roles = told["roles"]
    extent = [f(F.col(f"`{roles[a]}`").cast("double")).alias(f"{m}_{a}") for a in "xyz" for m, f in (("min", F.min), ("max", F.max))]
    back = spark.read.schema(rows.schema).parquet(f"{path}/runs/run={name}")
    return back.groupBy("_cell", "_rank", "_leaf_id").agg(F.count(F.lit(1)).alias("n_rows"), *extent).withColumn("run", F.lit(name))


def _switch(spark: SparkSession, path: str, found: DataFrame, version: int, told: dict) -> None:
    name = f"m{uuid.uuid4().hex}"
    found.write.parquet(f"{path}/_manifests/{name}")
    _create(spark, f"{path}/_versions/{version:010d}", json.dumps(told | {"manifest": name}))


def create(data: Dataset, path: str, key: str, shift: int = 0, file_rows: int = FILE_ROWS) -> None:
    """A stored octree of rows with assigned leaves; cells are leaf numbers without their last ``shift`` bits."""
    df = data.df.withColumnRenamed(data.rank, "_rank") if data.rank != "_rank" else data.df
    if not set(data.roles) >= set("xyz") or not {"_leaf_id", "_rank"} <= set(df.columns):
        raise ValueError("an octree needs the roles x, y, z, ranks and assigned leaves")
    told = {"key": key, "shift": shift, "file_rows": file_rows, "roles": data.roles, "schema": df.schema.json()}
    _switch(df.sparkSession, path, _run(df.sparkSession, path, df, told), 0, told)


def append(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Rows more, as a run of their own."""
    version, told = _state(spark, path)
    kept = _schema(told)
    if missing := set(kept.names) - set(rows.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kept.fields])
    found = _run(spark, path, rows, told)
    _switch(spark, path, spark.read.parquet(f"{path}/_manifests/{told['manifest']}").unionByName(found), version + 1, told)


def _schema(told: dict):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(told["schema"]))


def _rows(spark: SparkSession, path: str, told: dict, live: DataFrame) -> DataFrame:
    """Rows of the live (run, _cell), whose directories the scan takes from them where they are few."""
    from pyspark.sql.types import LongType, StringType

    live = live.select("run", "_cell").where("_cell >= 0").distinct()
    small = len(live.limit(BROADCAST_CELLS + 1).collect()) <= BROADCAST_CELLS
    kept = _schema(told)
    stored = spark.read.schema(kept.add("run", StringType()).add("_cell", LongType())).parquet(f"{path}/runs")
    return stored.join(F.broadcast(live) if small else live, ["run", "_cell"], "left_semi").select(*_schema(told).names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the newest version."""
    _, told = _state(spark, path)
    return _rows(spark, path, told, spark.read.parquet(f"{path}/_manifests/{told['manifest']}"))


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """_rank, _leaf_id, row_offset, n_rows, extent: leaf tables of all runs, merged."""
    found = manifest(spark, path)
    extent = [(F.min if c.startswith("min") else F.max)(c).alias(c) for c in found.columns if c[:4] in ("min_", "max_")]
    whole = found.groupBy("_rank", "_leaf_id").agg(F.sum("n_rows").alias("n_rows"), *extent)
    before = Window.partitionBy("_rank").orderBy("_leaf_id").rowsBetween(Window.unboundedPreceding, -1)
    return whole.withColumn("row_offset", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).cast("long"))


def region(spark: SparkSession, path: str, box: tuple[float, float, float, float, float, float]) -> DataFrame:
    """Rows in the closed box; only cells of runs with a part that meets it are read."""
    _, told = _state(spark, path)
    bounds = list(zip("xyz", box[::2], box[1::2], strict=True))
    found = spark.read.parquet(f"{path}/_manifests/{told['manifest']}")
    met = found.where(reduce(and_, [(F.col(f"max_{a}") >= float(lo)) & (F.col(f"min_{a}") <= float(hi)) for a, lo, hi in bounds]))
    return _rows(spark, path, told, met).where(reduce(and_, [F.col(f"`{told['roles'][a]}`").between(float(lo), float(hi)) for a, lo, hi in bounds]))


def positioned(spark: SparkSession, path: str) -> DataFrame:
    """Rows with ``_row_in_rank``: the position they would have if all runs had been written at once."""
    _, told = _state(spark, path)
    rows = numbered(read(spark, path).withColumn("_shuffle", shuffle_key(told["key"])), ["_rank", "_leaf_id"], ("_shuffle", told["key"]), "_row_in_leaf", "_leaf_rows")
    offsets = leaves(spark, path).select(F.col("_rank").alias("_r"), F.col("_leaf_id").alias("_l"), "row_offset")
    joined = rows.join(offsets, F.col("_rank").eqNullSafe(F.col("_r")) & (F.col("_leaf_id") == F.col("_l")))
    return joined.withColumn("_row_in_rank", F.col("row_offset") + F.col("_row_in_leaf")).drop("_shuffle", "_row_in_leaf", "_leaf_rows", "row_offset", "_r", "_l")


def compact(spark: SparkSession, path: str, most_runs: int = 1) -> int:
    """Merge the cells that have more than ``most_runs`` runs; how many these were."""
    version, told = _state(spark, path)
    found = spark.read.parquet(f"{path}/_manifests/{told['manifest']}")
    crowded = found.groupBy("_cell").agg(F.countDistinct("run").alias("n")).where(F.col("n") > most_runs).select("_cell")
    n = crowded.count()
    if n:
        made = _run(spark, path, _rows(spark, path, told, found.join(crowded, "_cell", "left_semi")), told)
        _switch(spark, path, found.join(crowded, "_cell", "left_anti").unionByName(made), version + 1, told)
    return n


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete cells of runs, and manifests and versions, that the newest version does not name; how many cells these were."""
    version, told = _state(spark, path)
    files, top = _file_system(spark, f"{path}/runs")
    stored = [(r.getPath(), c.getPath()) for r in files.listStatus(top) for c in files.listStatus(r.getPath()) if c.getPath().getName().startswith("_cell=")]
    names = spark.createDataFrame([(r.getName().removeprefix("run="), int(c.getName().removeprefix("_cell=")), i) for i, (r, c) in enumerate(stored)], "run string, _cell long, place int")
    dead = names.join(spark.read.parquet(f"{path}/_manifests/{told['manifest']}").select("run", "_cell").distinct(), ["run", "_cell"], "left_anti").collect()
    for row in dead:
        files.delete(stored[row["place"]][1], True)
    for name in _versions(spark, path):
        if int(name) < version:
            files.delete(_file_system(spark, f"{path}/_versions/{name}")[1], False)
    for m in files.listStatus(_file_system(spark, f"{path}/_manifests")[1]):
        if m.getPath().getName() != told["manifest"]:
            files.delete(m.getPath(), True)
    return len(dead)
