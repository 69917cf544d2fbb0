"""Stored octrees that grow, and steps that arrive."""

import random

import pytest
from pyspark.sql import functions as F

from astrolake.model import Dataset
from astrolake.operators import compare, octree
from astrolake.sources import generator, growing, ranked
from astrolake.streaming import changes

AXES = list("xyz")


@pytest.fixture(scope="module")
def box(spark):
    return generator.particles(spark, 150)


@pytest.fixture(scope="module")
def rows(box):
    axes = [F.col(a) for a in AXES]
    return octree.assign_leaf(octree.rank_grid(box.df.drop("_rank"), axes), axes, 2)


def files(spark, path):
    return {f for f in spark.read.parquet(f"{path}/runs").inputFiles()}


def test_append_equals_union(spark, box, rows, tmp_path):
    path, whole = f"{tmp_path}/g", f"{tmp_path}/w"
    parts = [rows.where(f"id % 5 = {i}") for i in range(3)] + [rows.where("id % 5 > 2 AND _leaf_id < 20")]
    growing.create(box.with_df(parts[0]), path, "id", shift=3, file_rows=40)
    for i, p in enumerate(parts[1:], 1):
        growing.append(spark, path, p)
        union = rows.where(f"id % 5 <= {min(i, 2)}" + (" OR (id % 5 > 2 AND _leaf_id < 20)" if i == 3 else ""))
        assert compare.identical(growing.read(spark, path).select(*rows.columns), union)
    ranked.write(box.with_df(union), whole, leaf_key="id")
    columns = ["_rank", "_leaf_id", "n_rows", "row_offset", "min_x", "max_z"]
    at_once = ranked.leaves(spark, whole).select(*columns)

    def same():
        assert compare.identical(growing.leaves(spark, path).select(*columns), at_once)
        assert compare.identical(growing.positioned(spark, path).select("id", "_rank", "_row_in_rank"), ranked.read(spark, whole).df.select("id", "_rank", "_row_in_rank"))
        region = (10.0, 100.0, 0.0, 50.0, 100.0, 200.0)
        assert compare.identical(growing.region(spark, path, region).select("id"), octree.region_rows(union, [F.col(a) for a in AXES], region).select("id"))

    same()
    before = files(spark, path)
    # the last run touched the first cells only
    touched = {r["_cell"] for r in growing.manifest(spark, path).groupBy("_cell").agg(F.countDistinct("run").alias("n")).where("n > 3").collect()}
    assert growing.compact(spark, path, 3) == len(touched) > 0
    same()
    assert before < files(spark, path)
    live = {(r["run"], r["_cell"]) for r in growing.manifest(spark, path).collect()}
    untouched = {f for f in before if int(f.split("_cell=")[1].split("/")[0]) not in touched}
    assert growing.vacuum(spark, path) == 4 * len(touched)
    after = files(spark, path)
    assert untouched and untouched <= after and {(f.split("run=")[1].split("/")[0], int(f.split("_cell=")[1].split("/")[0])) for f in after} == live
    same()
    assert growing.compact(spark, path, 3) == 0 and growing.compact(spark, path) > 0 and growing.compact(spark, path) == 0
    same()


def test_growing_conflicts_and_cases(spark, box, rows, tmp_path):
    path = f"{tmp_path}/c"
    growing.create(box.with_df(rows.where("id < 100")), path, "id")
    version, told = growing._state(spark, path)
    growing.append(spark, path, rows.where("id = 200"))
    with pytest.raises(growing.Conflict):
        growing._switch(spark, path, growing.manifest(spark, path), version + 1, told)
    assert growing.read(spark, path).count() == 101
    growing.append(spark, path, rows.where("false"))
    growing.append(spark, path, rows.where("id = 200"))
    assert growing.read(spark, path).where("id = 200").count() == 2
    with pytest.raises(ValueError):
        growing.append(spark, path, rows.drop("x"))
    with pytest.raises(ValueError):
        growing.create(Dataset(box.df.select("id", "_rank")), f"{tmp_path}/n", "id")
    plan = growing.region(spark, path, (0, 10, 0, 10, 0, 10))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_runs_are_written_by_tasks_of_bounded_size(spark, tmp_path):
    n = (1 << 20) + (1 << 18)
    rows = spark.range(n).select("id", *[F.lit(1.0).alias(a) for a in AXES], F.lit(0).alias("_rank"), F.lit(0).alias("_leaf_id"))
    growing.create(Dataset(rows), f"{tmp_path}/b", "id")
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/b/runs").groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == n and max(sizes) <= 1 << 20


def stepped(seed):
    rng = random.Random(seed)
    rows = []
    for step in range(6):
        for i in range(40):
            if rng.random() < 0.7:
                rows.append((step, i, float(rng.randrange(2)), 1.0 if i % 7 else None, 0.0))
    return rows + [rows[3], (rows[5][0], rows[5][1], 5.0, 1.0, 0.0)]


def plain_changes(rows):
    first = {}
    order = lambda t: [(v is not None, v) for v in t]
    for s, i, *v in rows:
        if (s, i) not in first or order(v) < order(first[s, i]):
            first[s, i] = v
    end, out = max(s for s, _ in first), set()
    for s, i in first:
        if (s - 1, i) not in first:
            out.add((i, s, "appeared"))
        elif first[s - 1, i] != first[s, i]:
            out.add((i, s, "moved"))
        if s < end and (s + 1, i) not in first:
            out.add((i, s + 1, "vanished"))
    return out


KINDS = "_step long, id long, x double, y double, z double"


def test_changes_of_steps(spark):
    rows = stepped(1)
    df = spark.createDataFrame(rows + [(None, 3, 1.0, 1.0, 1.0), (2, None, 1.0, 1.0, 1.0)], KINDS)
    got = changes.changes(df).collect()
    assert {tuple(r) for r in got} == plain_changes(rows) and len(got) == len(plain_changes(rows))
    assert changes.changes(df.where("false")).count() == 0


@pytest.mark.parametrize("each", [1, 2])
def test_arriving_steps_equal_the_batch(spark, tmp_path, each):
    rows = stepped(2)
    folder = tmp_path / "steps"
    for n in range(0, 6, each):
        spark.createDataFrame([r for r in rows if n <= r[0] < n + each], KINDS).coalesce(1).write.parquet(f"{folder}/{n}")
    stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    query = changes.arriving(stream).writeStream.format("memory").queryName(f"changed{each}").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table(f"changed{each}").collect()
    batch = changes.changes(spark.createDataFrame(rows, KINDS)).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in batch} == plain_changes(rows) and len(got) == len(batch)
