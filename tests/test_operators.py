"""Properties of the particle operators on small generated tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from astrolake.functions import typed
from astrolake.model import Dataset, infer_roles, percent_slice
from astrolake.operators import compare, octree, redistribute, sampling
from astrolake.operators.selection import AT_LEAST, BETWEEN, IS, Selection, load
from astrolake.sources import export, generator, ranked
from astrolake.streaming import steps

class _Axes:
    """Coordinate columns, made when a session is there."""

    def __iter__(self):
        return iter([F.col(a) for a in "xyz"])


AXES = _Axes()


@pytest.fixture(scope="module")
def box(spark):
    return generator.particles(spark, 200)


def test_roles():
    assert infer_roles(["fof_center_x", "fof_center_y", "fof_center_z", "x"]) == {"x": "fof_center_x", "y": "fof_center_y", "z": "fof_center_z"}
    assert infer_roles(["a_x", "x", "y", "z"]) == {"x": "x", "y": "y", "z": "z"}


def test_rowid_is_stable_and_dense(box):
    ids = [r["_rowid"] for r in box.extended().orderBy("_rank", "_row_in_rank").select("_rowid").collect()]
    assert ids == list(range(1, 1601))
    some = box.extended().where("_rank = 3").agg(F.min("_rowid"), F.max("_rowid")).first()
    assert tuple(some) == (601, 800)


def test_percent_bounds(box):
    e = box.extended()
    assert percent_slice(e, 0.5, 0.5, high_open=False).count() == 8
    assert percent_slice(e, high=0.1).count() == 8 * 20
    assert percent_slice(e, 0.9, 0.1).count() == 0


def test_selection(box):
    df = box.df
    assert Selection().apply(df).count() == 0
    assert Selection().add("nope", IS, 1).apply(df).count() == 0
    chosen = Selection().add("_rank", IS, "2").add("_rank", IS, "2").add("nope", IS, 1).add("x", AT_LEAST, "0")
    assert len(chosen.parts) == 3 and chosen.apply(df).count() == 200
    assert load(df, ["id"], ["x"], Selection().add("id", BETWEEN, 5, 9)).columns == ["x", "id"]


def test_samples_are_exact(box):
    got = {r["_rank"]: r["count"] for r in sampling.sample(box.df, 0.37, "id", power=sampling.LINEAR).groupBy("_rank").count().collect()}
    assert set(got.values()) == {74} and len(got) == 8
    assert sampling.sample(box.df, 0.5, "id").count() == 8 * 25
    assert sampling.sample(box.df, 0.37, "id").exceptAll(sampling.sample(box.df, 0.37, "id")).isEmpty()


def bisected(levels):
    """Boxes of one rank by repeated halving along x, y, z in turn."""
    boxes = [((0.0, 128.0),) * 3]
    for i in range(3 * (levels - 1)):
        out = []
        for b in boxes:
            lo, hi = b[i % 3]
            for part in ((lo, (lo + hi) / 2), ((lo + hi) / 2, hi)):
                out.append(b[: i % 3] + (part,) + b[i % 3 + 1 :])
        boxes = out
    return boxes


@pytest.mark.parametrize("levels", [2, 3])
def test_leaves_are_the_bisection(spark, levels):
    expected = bisected(levels)
    mids = [(i, *[(lo + hi) / 2 for lo, hi in b]) for i, b in enumerate(expected)]
    df = octree.rank_grid(spark.createDataFrame(mids, "want int, x double, y double, z double"), AXES)
    got = octree.leaf_boxes(octree.assign_leaf(df, AXES, levels), levels).collect()
    assert all(r["_leaf"] == r["want"] for r in got)
    assert all(((r["min_x"], r["max_x"]), (r["min_y"], r["max_y"]), (r["min_z"], r["max_z"])) == expected[r["want"]] for r in got)


def test_octree_verifies_and_regions_match(box):
    df = octree.assign_leaf(octree.rank_grid(box.df.drop("_rank"), AXES), AXES, 2)
    assert octree.violations(df, AXES, 2).count() == 0
    table = octree.leaf_table(df, 2)
    assert table.agg(F.sum("n_rows")).first()[0] == 1600
    region = (10.0, 100.0, 0.0, 50.0, 100.0, 200.0)
    inside = octree.region_rows(df, AXES, region)
    touched = {r["_leaf_id"] for r in octree.region_leaves(table, region).collect()}
    assert {r["_leaf_id"] for r in inside.select("_leaf_id").distinct().collect()} <= touched
    assert compare.identical(octree.clustered(df, "id", 4), df)
    assert octree.leaf_text(table).count() == table.count()


@pytest.mark.parametrize("n,readers", [(8, 3), (8, 8), (3, 5), (10, 4)])
def test_redistribution_covers_and_is_contiguous(spark, n, readers):
    for f in (redistribute.blocks_tail, redistribute.blocks_head, redistribute.blocks_last):
        got = [r[0] for r in spark.range(n).select(f(F.col("id"), n, readers)).collect()]
        assert got == sorted(got) and 0 <= got[0] and got[-1] < readers
    tail = [r[0] for r in spark.range(n).select(redistribute.blocks_tail(F.col("id"), n, readers)).collect()]
    sizes = [len(list(g)) for _, g in itertools.groupby(tail)]
    assert max(sizes) - min(sizes) <= 1


def test_compare_counts_duplicates(spark):
    a = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "v int, _rank int")
    b = spark.createDataFrame([(1, 0), (2, 1)], "v int, _rank int")
    assert [tuple(r) for r in compare.missing(a, b).collect()] == [(1, 0)]
    assert not compare.identical(a, b) and compare.identical(a, a)
    assert [r[0] for r in compare.verify(compare.digest(a), compare.digest(b)).collect()] == [0]


def test_crc64(spark):
    assert typed.crc64_of(b"123456789") == 0x995DC9BBDF1939FA
    rows = [(b"123456789",), (b"",), (None,), (bytes(range(256)),)]
    got = [int(r[0]) for r in spark.createDataFrame(rows, "b binary").select(typed.crc64("b")).collect()]
    assert got == [typed.crc64_of(r[0] or b"") for r in rows]


def test_vectors_and_labels(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0])], "id long, v array<float>")
    assert typed.flatten_vector(df, "v", 5).columns == ["id", "v.x", "v.y", "v.z", "v.w", "v.w1"]
    assert [r["label"] for r in typed.schema_table(df).collect()] == ["i64", "f32x?"]


def test_stored_tables(spark, box, tmp_path):
    ranked.write(box, f"{tmp_path}/t")
    back = ranked.read(spark, f"{tmp_path}/t")
    assert back.roles == box.roles and back.scale == box.scale
    assert compare.identical(back.df.select(*box.df.columns), box.df)
    some = ranked.row_range(back.df, 2, 10, 5)
    assert [r["_rowid"] for r in some.orderBy("_rowid").collect()] == list(range(411, 416))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_rank" in plan and "GreaterThanOrEqual(_row_in_rank,10)" in plan
    ranked.register(back, "box")
    assert "_percent" not in spark.table("box").columns and "_percent" in spark.table("box_extended").columns
    both = ranked.partitioned(spark, [f"{tmp_path}/t", f"{tmp_path}/t"])
    assert both.groupBy("_partition").count().count() == 2


def test_leaf_layout_prunes(spark, box, tmp_path):
    df = octree.assign_leaf(octree.rank_grid(box.df.drop("_rank"), AXES), AXES, 2)
    path = f"{tmp_path}/o"
    ranked.write(box.with_df(df), path, leaf_key="id")
    back = ranked.read(spark, path)
    assert compare.identical(back.df.select(*df.columns), df)
    # positions follow the stored leaves
    assert ranked.leaves(spark, path).count() == df.select("_leaf_id").distinct().count()
    for r in ranked.leaves(spark, path).orderBy("_leaf_id").collect()[::20]:
        got = ranked.row_range(back.df, r["_rank"], r["row_offset"], r["n_rows"]).select("_leaf_id").collect()
        assert {x[0] for x in got} == {r["_leaf_id"]} and len(got) == r["n_rows"]
        assert compare.identical(ranked.leaf(spark, path, r["_leaf_id"]).select("id"), df.where(F.col("_leaf_id") == r["_leaf_id"]).select("id"))
    region = (10.0, 100.0, 0.0, 50.0, 100.0, 200.0)
    for listed in (4096, 0):
        assert compare.identical(ranked.region(spark, path, region, listed).select("id"), octree.region_rows(df, AXES, region).select("id"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = ranked.region(spark, path, region)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [_rank" in plan and "In(_leaf_id" in plan and "GreaterThanOrEqual(x,10.0)" in plan
    with pytest.raises(ValueError):
        ranked.write(Dataset(box.df.select("id", "_rank")), f"{tmp_path}/none", leaf_key="id")


def test_partitioned_and_rank_map(spark, box, tmp_path):
    ranked.write_partitioned(box.df, f"{tmp_path}/p", F.col("_rank") % 3)
    assert {(r["_rank"], r["_partition"], r["n_rows"]) for r in ranked.rank_map(spark, f"{tmp_path}/p").collect()} == {(r, r % 3, 200) for r in range(8)}
    one = ranked.read_rank(spark, f"{tmp_path}/p", 4)
    assert compare.identical(one.select("id"), box.df.where("_rank = 4").select("id")) and len(one.inputFiles()) >= 1
    assert ranked.read_rank(spark, f"{tmp_path}/p", 99).isEmpty()


@pytest.mark.parametrize("cell_rows", [7, 300])
def test_positions_of_large_groups(box, cell_rows):
    """Ranges and running sums give what a window gives."""
    from astrolake.model import numbered

    rows = box.df.withColumn("_rank", F.when(F.col("_rank") > 5, None).otherwise(F.col("_rank")))
    small, large = (numbered(rows, ["_rank"], ("x", "id"), "p", "n", most, cell_rows).select("id", "_rank", "p", "n") for most in (1 << 20, 10))
    assert compare.identical(small, large) and small.agg(F.max("n")).first()[0] == 400


def test_digest_tells_nulls_apart(spark):
    a = spark.createDataFrame([(1, None, 0), (None, 2, 0)], "u int, v int, _rank int")
    b = spark.createDataFrame([(None, 1, 0), (2, None, 0)], "u int, v int, _rank int")
    assert compare.verify(compare.digest(a), compare.digest(b)).count() == 1
    assert compare.verify(compare.digest(a), compare.digest(a.select("v", "_rank", "u"))).count() == 0


def test_values_as_text(spark):
    values = [0.0, 1.0, -2.5, 123456.0, 1234567.0, 0.0001, 0.00001234, 999999.5, 1e300, -1e-300, 3.14159265, 100000.0, 1e15]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select("v", typed.to_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["%g" % v for v in values] + [None]


def test_exports(spark, box, tmp_path):
    import numpy as np

    export.write_table(box.df.select("id", "x"), f"{tmp_path}/tsv")
    assert spark.read.text(f"{tmp_path}/tsv/rows").count() == 1600
    assert spark.read.text(f"{tmp_path}/tsv/_header").first()[0].startswith("# id\tx")
    blocks = export.row_major(box.df, block_rows=70).collect()
    assert sum(b["n_rows"] for b in blocks) == 1600 and len({(b["_rank"], b["block"]) for b in blocks}) == len(blocks) == 24
    whole = b"".join(bytes(b["data"]) for b in sorted(blocks, key=lambda b: (b["_rank"], b["block"])))
    assert np.frombuffer(whole, np.dtype(list(export.ROW_MAJOR)))["id"].tolist() == list(range(1600))
    export.write_row_major(box.df, f"{tmp_path}/records")
    assert spark.read.parquet(f"{tmp_path}/records").agg(F.sum("n_rows")).first()[0] == 1600
    first = np.frombuffer(bytes(blocks[0]["data"]), np.dtype(list(export.ROW_MAJOR)))
    want = {r["id"]: r["x"] for r in box.df.select("id", "x").collect()}
    assert all(want[int(i)] == x for i, x in zip(first["id"], first["x"], strict=True))
    export.write_csv(box.df.select("id"), f"{tmp_path}/csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").count() == 1600


def test_series_and_stream(spark, tmp_path):
    for i in (3, 4):
        spark.range(5).withColumn("ts", F.to_timestamp(F.lit(f"2024-01-0{i} 00:30:00"))).withColumn("event_type", F.lit("a")).withColumn("value", F.lit(1.0)).coalesce(1).write.parquet(f"{tmp_path}/steps/{i}")
    got = ranked.series(spark, f"{tmp_path}/steps/*", r"/(\d+)/[^/]*$").groupBy("_step").count().collect()
    assert {(r["_step"], r["count"]) for r in got} == {(3, 5), (4, 5)}
    schema = spark.read.parquet(f"{tmp_path}/steps/3").schema
    query = steps.windowed_counts(steps.steps(spark, f"{tmp_path}/steps/*", schema)).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {r["n"] for r in spark.table("counts").collect()} == {5}


def test_natural_partition(spark):
    row = spark.createDataFrame([("ab", 5)], "host string, r int").select(redistribute.natural_partition(F.col("host")), redistribute.natural_partition(F.col("host"), F.col("r"), 4)).first()
    assert tuple(row) == ((97 + 98) % 256, (97 + 98) % 256 * 4 + 1)


def test_dataset_leaf_percent(box):
    df = octree.assign_leaf(octree.rank_grid(box.df.drop("_rank"), AXES), AXES, 2)
    e = Dataset(df).extended("_leaf_id")
    assert e.agg(F.min("_percent")).first()[0] == 0 and e.agg(F.max("_percent")).first()[0] < 1
