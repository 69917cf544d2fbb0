"""Ranked tables in Parquet: partition directories per rank, hidden columns stored with the rows, a sidecar of metadata."""

from __future__ import annotations

import json
from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrolake.model import Dataset


#: Rows of a block: the unit of extents, digests and comparisons, and unless told otherwise a directory of one file, which one task writes.
BLOCK_ROWS = 1 << 22
#: Blocks that a read picks by a broadcast; more of them are picked by a shuffle.
BROADCAST_BLOCKS = 1 << 16

HIDDEN = ["_row_in_rank", "_rank_rows", "_rowid", "_percent"]


def write(data: Dataset, path: str, compression: str = "zstd", leaf_key: str | None = None, shuffled_by: str | None = None, block_rows: int = BLOCK_ROWS, file_rows: int | None = None) -> None:
    """Store a table with its positions, so that rank, row range and percent filters are plain scan filters.

    Rows of a rank stand in directories ``_rank``, ``_block`` (rows of the table before it) of
    ``file_rows``, each written by one task, so a large rank is written by many.  A directory
    holds one block of ``block_rows``, or a whole number of them where ``file_rows`` is larger:
    fine blocks cost rows of the table of parts, not files.  Beside the rows goes that table of
    parts (rows of a block, with ``leaf_key`` of one leaf in a block): first row, rows, extent,
    digest and ``_held``, the directory.  Reads that need some blocks only, counts, extents and
    comparisons start there.

    With ``leaf_key`` the order of rows is that of leaves, shuffled inside a leaf; with
    ``shuffled_by`` it is the shuffled order of the whole rank.  Positions, percents and row
    ids follow it.  Pages carry checksums, which readers verify."""
    file_rows = block_rows if file_rows is None else file_rows
    if file_rows % block_rows:
        raise ValueError("a directory holds whole blocks")
    if leaf_key is not None and (not set(data.roles) >= set("xyz") or "_leaf_id" not in data.df.columns):
        raise ValueError("an octree needs the roles x, y, z and assigned leaves")
    if key := leaf_key or shuffled_by:
        from astrolake.operators.sampling import shuffle_key

        data = replace(data, df=data.df.withColumn("_shuffle", shuffle_key(key)), order=(*(["_leaf_id"] if leaf_key else []), "_shuffle", key))
    rows = data.extended().drop("_shuffle")
    rows = rows.withColumnRenamed(data.rank, "_rank") if data.rank != "_rank" else rows
    rows = rows.withColumn("_block", block_of(file_rows))
    n_files = data.ranks().agg(F.sum(F.ceil(F.col("n_rows") / file_rows))).first()[0]
    rows = rows.repartition(int(max(n_files or 0, 1)), "_rank", "_block").sortWithinPartitions("_rank", "_block", "_row_in_rank")
    rows.write.partitionBy("_rank", "_block").option("compression", compression).option("parquet.page.write-checksum.enabled", "true").parquet(path)
    spark = data.df.sparkSession
    part_table(spark.read.schema(rows.schema).parquet(path), data.roles, block_rows).write.parquet(f"{path}/_parts")
    order = [c for c in data.order if c != "_shuffle"]
    sidecar = json.dumps({"roles": data.roles, "order": order, "origin": list(data.origin), "scale": list(data.scale), "block_rows": block_rows})
    spark.createDataFrame([(sidecar,)], "value string").coalesce(1).write.text(f"{path}/_table")


def block_of(n: int) -> Column:
    """Rows of the table before the block of ``n`` rows that a stored row is in."""
    return F.col("_rowid") - 1 - F.pmod(F.col("_row_in_rank"), F.lit(n))


def part_keys(df: DataFrame) -> list[str]:
    return ["_rank", "_block", *(["_leaf_id"] if "_leaf_id" in df.columns else [])]


def part_table(stored: DataFrame, roles: dict[str, str], block_rows: int) -> DataFrame:
    """_held (directory), first_row, n_rows, min_x .. max_z (of role columns) and digest of the rows of every part."""
    from astrolake.operators.compare import row_hash

    extent = [f(F.col(f"`{roles[a]}`").cast("double")).alias(f"{n}_{a}") for a in "xyz" if a in roles for n, f in (("min", F.min), ("max", F.max))]
    h = row_hash([c for c in stored.columns if c not in (*HIDDEN, "_rank", "_block")])
    digest = [F.sum(h.cast("decimal(38,0)")).alias("sum_hash"), F.bit_xor(h).alias("xor_hash")]
    stored = stored.withColumnRenamed("_block", "_held").withColumn("_block", block_of(block_rows))
    return stored.groupBy(*part_keys(stored), "_held").agg(F.min("_row_in_rank").alias("first_row"), F.count(F.lit(1)).alias("n_rows"), *extent, *digest)


def parts(spark: SparkSession, path: str) -> DataFrame:
    """The stored table of parts: it is as long as the table has blocks, and occupied leaves.

    Tables from before directories of several blocks have one directory for each."""
    found = spark.read.parquet(f"{path}/_parts")
    return found if "_held" in found.columns else found.withColumn("_held", F.col("_block"))


def _over(found: DataFrame, *keys: str) -> DataFrame:
    """Parts summed up by keys."""
    extent = [(F.min if c.startswith("min") else F.max)(c).alias(c) for c in found.columns if c[:4] in ("min_", "max_")]
    return found.groupBy(*keys).agg(F.min("first_row").alias("first_row"), F.sum("n_rows").alias("n_rows"), *extent, F.sum("sum_hash").alias("sum_hash"), F.bit_xor("xor_hash").alias("xor_hash"))


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """_rank, _block, _held, first_row, n_rows, extent and digest of every block."""
    return _over(parts(spark, path), "_rank", "_block", "_held")


def directories(spark: SparkSession, path: str) -> DataFrame:
    """_rank, _block, first_row, n_rows, extent and digest of every directory, under the name that its rows have."""
    return _over(parts(spark, path), "_rank", "_held").withColumnRenamed("_held", "_block")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """_rank, n_rows, rank_offset and extent of every rank, from the parts alone: no row is read."""
    ranks = _over(parts(spark, path), "_rank").drop("first_row", "sum_hash", "xor_hash")
    return ranks.withColumn("rank_offset", F.coalesce(F.sum("n_rows").over(Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def header(spark: SparkSession, path: str) -> DataFrame:
    """(section, name, value) of what stands beside the rows: table (rows, blocks, box, roles), columns with their types, ranks with their rows, leaves with theirs."""
    from astrolake.functions.typed import type_label

    told = _told(spark, path)
    fields = [f for f in read(spark, path).df.schema.fields if f.name not in (*HIDDEN, "_block")]
    rows = [("table", "block_rows", str(told["block_rows"])), ("table", "order", ",".join(told["order"]))]
    rows += [("table", f"origin_{a}", str(o)) for a, o in zip("xyz", told["origin"], strict=True)] + [("table", f"scale_{a}", str(o)) for a, o in zip("xyz", told["scale"], strict=True)]
    rows += [("role", a, c) for a, c in told["roles"].items()] + [("column", f.name, type_label(f)) for f in fields]
    found = parts(spark, path)

    def counted(section: str, key: str) -> DataFrame:
        return found.groupBy(key).agg(F.sum("n_rows").cast("string").alias("value")).select(F.lit(section).alias("section"), F.col(key).cast("string").alias("name"), "value")

    whole = found.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("string").alias("n_rows"), F.countDistinct("_block").cast("string").alias("n_blocks"), F.countDistinct("_rank").cast("string").alias("n_ranks"))
    whole = whole.select(F.explode(F.array(*[F.struct(F.lit("table").alias("section"), F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("n_rows", "n_blocks", "n_ranks")])).alias("h")).select("h.*")
    all_of = [spark.createDataFrame(rows, "section string, name string, value string"), whole, counted("rank", "_rank"), *([counted("leaf", "_leaf_id")] if "_leaf_id" in found.columns else [])]
    return reduce(DataFrame.unionByName, all_of)


def _few(wanted: DataFrame) -> DataFrame:
    """Marked for a broadcast, if it has up to ``BROADCAST_BLOCKS`` rows."""
    return F.broadcast(wanted) if wanted.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS else wanted


def picked(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows of the directories that ``wanted`` (_rank, _block, repeated at will) names.

    Up to ``BROADCAST_BLOCKS`` are broadcast; the scan then takes its directories from them
    by dynamic partition pruning.  More of them are joined by a shuffle."""
    wanted = wanted.select("_rank", "_block").where("_block >= 0").distinct()
    return read(spark, path).df.join(_few(wanted), ["_rank", "_block"], "left_semi")


def picked_blocks(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows of the blocks that ``wanted`` (of ``blocks``, repeated at will) names; only their directories are read."""
    data = picked(spark, path, wanted.select("_rank", F.col("_held").alias("_block")))
    wanted = wanted.select("_rank", F.col("_block").alias("_in")).distinct()
    return data.withColumn("_in", block_of(block_rows(spark, path))).join(_few(wanted), ["_rank", "_in"], "left_semi").drop("_in")


def sample(spark: SparkSession, path: str, share: float, power: int = 1) -> DataFrame:
    """Exactly round(n * share**power) rows of every rank of a table stored with ``shuffled_by``.

    They are the first ones, so samples of rising shares hold each other, and only the
    directories in front are read."""
    part = F.lit(float(share) ** power)
    ranks = _over(parts(spark, path), "_rank").select("_rank", F.round(F.col("n_rows") * part).alias("_take"))
    wanted = directories(spark, path).join(ranks, "_rank").where(F.col("first_row") < F.col("_take"))
    return picked(spark, path, wanted).where(F.col("_row_in_rank") < F.round(F.col("_rank_rows") * part))


def leaf_prefix(spark: SparkSession, path: str, share: float) -> DataFrame:
    """First trunc(n * share) rows of every leaf of a stored octree.

    Leaves are ranges of positions, and directories are bins of them: the leaves in
    directories that hold wanted positions meet the rows, and directories without any are not read."""
    leaf = Window.partitionBy("_rank", "_leaf_id")
    found = _over(parts(spark, path), "_rank", "_held", "_leaf_id").withColumnRenamed("_held", "_block")
    ends = found.withColumn("_end", F.min("first_row").over(leaf) + F.floor(F.sum("n_rows").over(leaf) * F.lit(float(share))))
    wanted = ends.where(F.col("first_row") < F.col("_end")).select("_rank", "_block", "_leaf_id", "_end")
    return read(spark, path).df.join(_few(wanted), ["_rank", "_block", "_leaf_id"]).where(F.col("_row_in_rank") < F.col("_end")).drop("_end")


def _same_digest(a: str, b: str) -> Column:
    return reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("n_rows", "sum_hash", "xor_hash")])


def differing_blocks(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(_rank, first_row, last_row) of the blocks in which two stored tables differ.

    Stored digests are compared from the top: those of ranks first, then those of the blocks
    of ranks that differ.  No row is read."""

    def differing(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        return x.alias("a").join(y.alias("b"), keys, "full").where(~_same_digest("a", "b")).select(*keys, F.greatest("a.n_rows", "b.n_rows").alias("n_rows"))

    pa, pb = parts(spark, a), parts(spark, b)
    ranks = differing(_over(pa, "_rank"), _over(pb, "_rank"), ["_rank"]).select("_rank")
    found = differing(*[_over(p.join(ranks, "_rank", "left_semi"), "_rank", "_block") for p in (pa, pb)], ["_rank", "first_row"])
    return found.select("_rank", "first_row", (F.col("first_row") + F.col("n_rows") - 1).alias("last_row"))


def differing_rows(spark: SparkSession, a: str, b: str) -> DataFrame:
    """Rows (without hidden columns) that ``a`` has more often than ``b``; only blocks that differ are compared, and only their directories read."""
    wanted = differing_blocks(spark, a, b).select("_rank", "first_row")
    found = [picked_blocks(spark, p, blocks(spark, p).join(wanted, ["_rank", "first_row"], "left_semi")) for p in (a, b)]
    columns = [c for c in found[0].columns if c not in (*HIDDEN, "_block")]
    return found[0].select(*columns).exceptAll(found[1].select(*columns))


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(_rank, first_row, last_row) of blocks whose rows no longer give the digest stored with them."""
    data = read(spark, path)
    now = part_table(data.df, data.roles, block_rows(spark, path))
    joined = parts(spark, path).alias("a").join(now.alias("b"), part_keys(now), "full").where(~_same_digest("a", "b"))
    end = [F.col(f"{t}.first_row") + F.col(f"{t}.n_rows") - 1 for t in "ab"]
    found = joined.select("_rank", "_block", F.least("a.first_row", "b.first_row").alias("first_row"), F.greatest(*end).alias("last_row"))
    return found.groupBy("_rank", "_block").agg(F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row")).drop("_block")


def _told(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/_table").first()["value"])


def block_rows(spark: SparkSession, path: str) -> int:
    return _told(spark, path)["block_rows"]


def read(spark: SparkSession, path: str) -> Dataset:
    """The table with roles and box; wrong page checksums fail the read."""
    meta = _told(spark, path)
    df = spark.read.option("parquet.page.verify-checksum.enabled", "true").parquet(path)
    return Dataset(df, "_rank", tuple(meta["order"]), meta["roles"], tuple(meta["origin"]), tuple(meta["scale"]))


def row_range(df: DataFrame, rank: int, offset: int, count: int) -> DataFrame:
    """Rows offset .. offset+count-1 of a rank: a partition filter and a pushed-down range."""
    return df.where((F.col("_rank") == rank) & F.col("_row_in_rank").between(offset, offset + count - 1))


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """The table of leaves: _rank, _leaf_id, row_offset, n_rows, min_x .. max_z (of the rows in it)."""
    return _over(parts(spark, path), "_rank", "_leaf_id").withColumnRenamed("first_row", "row_offset").drop("sum_hash", "xor_hash")


def leaf(spark: SparkSession, path: str, leaf_id: int) -> DataFrame:
    """Rows of one leaf: its rank, first row and rows come from the table of leaves."""
    df = read(spark, path).df
    found = leaves(spark, path).where(F.col("_leaf_id") == leaf_id).first()
    return df.where(F.lit(False)) if found is None else row_range(df, found["_rank"], found["row_offset"], found["n_rows"])


def region(spark: SparkSession, path: str, box: tuple[float, float, float, float, float, float], listed: int = 4096) -> DataFrame:
    """Rows in the closed box (x0, x1, y0, y1, z0, z1).

    Leaves whose extent meets it are looked up first.  Up to ``listed`` become filters on
    rank (directories) and leaf (row groups), more of them a join; the rows themselves are
    tested in any case."""
    data = read(spark, path)
    bounds = list(zip("xyz", box[::2], box[1::2], strict=True))
    touched = leaves(spark, path).where(reduce(and_, [(F.col(f"max_{a}") >= float(lo)) & (F.col(f"min_{a}") <= float(hi)) for a, lo, hi in bounds])).select("_rank", "_leaf_id")
    few = touched.limit(listed + 1).collect()
    if len(few) <= listed:
        df = data.df.where(F.col("_rank").isin(sorted({r["_rank"] for r in few})) & F.col("_leaf_id").isin(sorted({r["_leaf_id"] for r in few})))
    else:
        df = data.df.join(touched, ["_rank", "_leaf_id"], "left_semi")
    return df.where(reduce(and_, [F.col(f"`{data.roles[a]}`").between(float(lo), float(hi)) for a, lo, hi in bounds]))


def write_partitioned(df: DataFrame, path: str, partition: Column, rank: str = "_rank", file_rows: int = BLOCK_ROWS) -> None:
    """A directory per partition of ranks, and the map from rank to partition beside them.

    Partitions are written by range, in files of about ``file_rows`` rows: a large one is not one task's."""
    rows = df.withColumn("_partition", partition.cast("int"))
    rows = rows.repartitionByRange(max(1, -(-rows.count() // file_rows)), "_partition", rank, *[F.col(f"`{c}`") for c in df.columns if c != rank][:1])
    rows.write.partitionBy("_partition").parquet(path)
    spark = df.sparkSession
    spark.read.parquet(path).groupBy(F.col(rank).alias("_rank"), "_partition").agg(F.count(F.lit(1)).alias("n_rows")).coalesce(1).write.parquet(f"{path}/_ranks")


def rank_map(spark: SparkSession, path: str) -> DataFrame:
    """_rank, _partition, n_rows of a partitioned table."""
    return spark.read.parquet(f"{path}/_ranks")


def read_rank(spark: SparkSession, path: str, rank: int, column: str = "_rank") -> DataFrame:
    """Rows of one rank: only the partition that the map names is read."""
    held = [r["_partition"] for r in rank_map(spark, path).where(F.col("_rank") == rank).select("_partition").distinct().collect()]
    return spark.read.parquet(path).where(F.col("_partition").isin(held) & (F.col(column) == rank))


def partitioned(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One table over several paths, with ``_partition`` telling which."""
    parts = [spark.read.parquet(p).withColumn("_partition", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def series(spark: SparkSession, pattern: str, step: str = r"(\d+)(?:\.\w+)?/?[^/]*$") -> DataFrame:
    """Files of several time steps as one table; ``_step`` is the number in the path."""
    return spark.read.parquet(pattern).withColumn("_step", F.regexp_extract(F.input_file_name(), step, 1).cast("int"))


def register(data: Dataset, name: str) -> None:
    """Views for SQL: ``name`` as the table stands, ``name_extended`` with the hidden columns."""
    shown = [c for c in data.df.columns if c not in (*HIDDEN, "_rank", "_block")]
    data.df.select(*[F.col(f"`{c}`") for c in shown]).createOrReplaceTempView(name)
    (data.df if set(HIDDEN) <= set(data.df.columns) else data.extended()).drop("_block").createOrReplaceTempView(f"{name}_extended")


def register_stored(spark: SparkSession, path: str, name: str) -> None:
    """The views of ``register``, and for SQL a table function ``name_region(x0, x1, y0, y1, z0, z1)``: rows of the closed box.

    It joins the rows with the directories whose extent meets the box, so a query with it reads only
    these (dynamic partition pruning), which a condition on x, y, z of a view alone cannot do."""
    data = read(spark, path)
    register(data, name)
    data.df.createOrReplaceTempView(f"{name}_stored")
    directories(spark, path).createOrReplaceTempView(f"{name}_blocks")
    kept = [f for f in data.df.schema.fields if f.name not in (*HIDDEN, "_block")]
    bounds = [(a, f"{a}0", f"{a}1") for a in "xyz"]
    meets = " AND ".join(f"b.max_{a} >= {name}_region.{lo} AND b.min_{a} <= {name}_region.{hi}" for a, lo, hi in bounds)
    inside = " AND ".join(f"r.`{data.roles[a]}` BETWEEN {name}_region.{lo} AND {name}_region.{hi}" for a, lo, hi in bounds)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}_region({", ".join(f"{x} DOUBLE" for _, lo, hi in bounds for x in (lo, hi))})
        RETURNS TABLE({", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)})
        RETURN SELECT {", ".join(f"r.`{f.name}`" for f in kept)} FROM {name}_stored r JOIN {name}_blocks b ON r._rank = b._rank AND r._block = b._block
        WHERE {meets} AND {inside}""")
