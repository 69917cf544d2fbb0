"""Points in a table of boxes, and leaves of bounded size, against loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from astrolake.operators import adaptive, boxes, octree


class _Axes:
    """Coordinate columns, made when a session is there."""

    def __iter__(self):
        return iter([F.col(a) for a in "xyz"])


AXES = _Axes()
NAN = float("nan")


def inside(p, b, periodic):
    for v, lo, hi in zip(p, b[::2], b[1::2], strict=True):
        if v is None or lo is None or hi is None or v != v or lo != lo or hi != hi or lo > hi:
            return False
        shifts = range(-4, 5) if periodic else (0,)
        if not (any(lo <= v + 256 * s <= hi for s in shifts) or (periodic and hi - lo >= 256)):
            return False
    return True


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(2)
    grid = lambda top: rng.randrange(0, top * 4 + 1) / 4
    points = [(i, grid(256), grid(256), grid(256)) for i in range(400)] + [(1000 + i, 40.0, 40.0, 40.0) for i in range(60)]
    points += [(500, 0.0, 0.0, 0.0), (501, 256.0, 256.0, 256.0), (502, 0.0, 128.0, 256.0), (503, None, 1.0, 1.0), (504, NAN, 1.0, 1.0), (500, 0.0, 0.0, 0.0)]
    found = []
    for i in range(120):
        low = [grid(255) for _ in range(3)]
        width = [rng.choice([0.0, 0.25, 3.0, 20.0, 90.0, 200.0]) for _ in range(3)]
        found.append((i, *[v for lo, w in zip(low, width, strict=True) for v in (lo, lo + w)]))
    found += [(200, 0.0, 256.0, 0.0, 256.0, 0.0, 256.0), (201, -300.0, 900.0, 40.0, 40.0, 39.0, 41.0), (202, 39.0, 41.0, 39.0, 41.0, 39.0, 41.0), (203, 250.0, 262.0, 250.0, 262.0, 250.0, 262.0)]
    found += [(204, 762.0, 774.0, -6.0, 6.0, 128.0, 256.0), (205, 10.0, 5.0, 0.0, 256.0, 0.0, 256.0), (206, None, 5.0, 0.0, 1.0, 0.0, 1.0), (207, 0.0, NAN, 0.0, 1.0, 0.0, 1.0), (208, 256.0, 256.0, 0.0, 0.0, 0.0, 256.0), (202, 39.0, 41.0, 39.0, 41.0, 39.0, 41.0)]
    return points, found, spark.createDataFrame(points, "id long, x double, y double, z double").repartition(3), spark.createDataFrame(found, "box_id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double").repartition(2)


@pytest.mark.parametrize("options", [{}, {"broadcast_cells": 0, "heavy_points": 7}, {"most_cells": 5000, "broadcast_cells": 0}])
@pytest.mark.parametrize("periodic", [False, True])
def test_box_join(given, options, periodic):
    points, found, p, b = given
    got = sorted(tuple(r) for r in boxes.box_join(p, b, AXES, periodic=periodic, **options).select("box_id", "id").collect())
    assert got == sorted((q[0], r[0]) for q in found for r in points if inside(r[1:], q[1:], periodic))


def test_box_join_plan(given):
    _, _, p, b = given
    for options in ({}, {"broadcast_cells": 0}):
        plan = boxes.box_join(p, b, AXES, **options)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        boxes.box_join(p, b.withColumn("id", F.lit(1)), AXES)
    assert boxes.box_join(p, b.where("false"), AXES).count() == 0 and boxes.box_join(p.where("false"), b, AXES).count() == 0


def test_heavy_cells_are_split(given):
    _, _, p, b = given
    cells = boxes.box_cells(b, most_cells=1)
    keyed = boxes.point_cells(p, AXES, [0, 10])
    heavy = {(r["_level"], r["_cell"]): r["_keys"] for r in boxes.heavy_cells(keyed, cells, 50).collect()}
    assert heavy[0, 0] == math.ceil(464 / 50) and max(heavy.values()) == heavy[0, 0]


@pytest.mark.parametrize("most,depth", [(1, 3), (20, 4), (100, 10), (10_000, 5)])
def test_adaptive_leaves(given, most, depth):
    points, _, p, _ = given
    p = p.where("id not in (503, 504)")
    leaves = adaptive.adaptive_leaves(p, AXES, most, depth)
    rows = sorted(leaves.collect(), key=lambda r: r["_first"])
    assert sum(r["n_rows"] for r in rows) == len(points) - 2
    assert all(r["n_rows"] <= most or r["_level"] == depth for r in rows)
    assert all(a["_last"] < b["_first"] for a, b in zip(rows, rows[1:], strict=False))
    for few in (1 << 16, 0):
        placed = adaptive.assign(p, AXES, leaves, depth, broadcast_leaves=few)
        joined = placed.join(leaves.select("_level", "_code", "n_rows", *[f"{m}_{a}" for m in ("min", "max") for a in "xyz"]), ["_level", "_code"])
        assert placed.count() == len(points) - 2
        assert joined.where(" OR ".join(f"{a} < min_{a} OR {a} > max_{a}" for a in "xyz")).count() == 0
        assert placed.groupBy("_first").count().join(leaves, "_first").where("count <> n_rows").count() == 0
    # a parent of a leaf never fits
    codes = [int(r[0]) for r in p.select(adaptive.fine_code(list(AXES), depth)).collect()]
    for r in rows:
        if r["_level"]:
            shift = 3 * (depth - r["_level"] + 1)
            assert sum(c >> shift == r["_code"] >> 3 for c in codes) > most


def test_adaptive_leaves_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, x double, y double, z double")
    leaves = adaptive.adaptive_leaves(empty, AXES, 5)
    assert leaves.count() == 0 and adaptive.assign(empty, AXES, leaves).count() == 0


def test_large_leaf_numbers(spark):
    df = spark.createDataFrame([(255.99, 255.99, 255.99)], "x double, y double, z double")
    got = octree.assign_leaf(octree.rank_grid(df, AXES, parts=4), AXES, 11, parts=4).first()
    assert got["_leaf_id"] == 63 * 8**10 + 8**10 - 1


@pytest.mark.parametrize("options", [{"most_copies": 2}, {"most_copies": 2, "broadcast_cells": 0, "heavy_points": 7}])
def test_boxes_of_equal_bounds(given, options):
    points, found, p, b = given
    b = b.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("box_id") % 7).cast("int"))))
    got = sorted(tuple(r) for r in boxes.box_join(p, b, AXES, **options).select("box_id", "copy", "x0", "z1", "id").collect())
    assert got == sorted((q[0], n, q[1], q[6], r[0]) for q in found for n in range(q[0] % 7 + 1) for r in points if inside(r[1:], q[1:], False))
    lists = boxes.copies(b, most=2).select("x0", F.size("_copies").alias("n")).collect()
    assert sum(r["n"] for r in lists) == sum(q[0] % 7 + 1 for q in found if q[0] not in (205, 206, 207))
    one = boxes.box_join(p, b.select(*boxes.BOUNDS), AXES, **options)
    assert one.columns == ["id", "x", "y", "z", *boxes.BOUNDS] and one.count() == len(got)


def test_points_and_boxes_are_shuffled_once(given):
    _, _, p, b = given
    plan = boxes.box_join(p, b, AXES, broadcast_cells=0, heavy_points=7).select("box_id", "id")._jdf.queryExecution().executedPlan().toString()
    by_cell = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "_cell" in line]
    assert len(by_cell) == 2


@pytest.mark.parametrize("options", [{}, {"broadcast_cells": 0, "heavy_points": 7}])
@pytest.mark.parametrize("periodic", [False, True])
def test_box_aggregates(given, options, periodic):
    points, found, p, b = given
    b = b.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("box_id") % 7).cast("int"))))
    got = boxes.box_aggregates(p, b, AXES, [F.count(F.lit(1)).alias("n"), F.min("id").alias("least")], periodic=periodic, **options)
    held = [(q, [r[0] for r in points if inside(r[1:], q[1:], periodic)]) for q in found]
    assert sorted(tuple(r) for r in got.select("box_id", "copy", "n", "least").collect()) == sorted((q[0], i, len(ids), min(ids)) for q, ids in held if ids for i in range(q[0] % 7 + 1))
    assert got.columns == [*b.columns, "n", "least"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "NestedLoop" not in plan


def test_periodic_query_aggregates_equal_boxes_once(spark, tmp_path):
    from astrolake.plans import catalog

    spark.createDataFrame([(i, i % 40, float(i * 37 % 20000)) for i in range(900)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    # bounds repeat every lcm(1024, 300) keys: fifty boxes, four times
    spark.range(50).selectExpr("explode(transform(sequence(0, 3), i -> id * 100 + i * 76800)) AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.box_join_periodic(spark, str(tmp_path))
    rows = {r["box_id"]: (r["n_rows"], r["least"]) for r in got.collect()}
    assert len(rows) >= 40 and all(rows.get(k % 76800) == v for k, v in rows.items())
    assert {k % 76800 + 76800 * i for k in rows for i in range(4)} == set(rows)
    # the join of points with cells comes after boxes have been made distinct, below the join with all boxes
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "Generate explode(_b" not in plan


def test_pairs_are_small_when_written(spark, tmp_path):
    rng = random.Random(3)
    place = lambda low, high: rng.randrange(low * 100, high * 100) / 100
    points = [(i, *[place(64, 96) for _ in range(3)]) for i in range(1500)]
    low = [[place(60, 80) for _ in range(3)] for _ in range(400)]
    found = [(i + 1000 * copy, *[v for a in low[i] for v in (a, a + 14.0)]) for copy in range(70) for i in range(400)]
    p, b = spark.createDataFrame(points, "id long, x double, y double, z double"), spark.createDataFrame(found, "box_id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    boxes.box_join(p, b, AXES, broadcast_cells=0).select("box_id", "id").write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    held = sum(inside(r[1:], [v for a in q for v in (a, a + 14.0)], False) for q in low for r in points)
    assert got.count() == got.distinct().count() == 70 * held > 1_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 70 * held


@pytest.mark.parametrize("depth", [0, 2])
def test_blocks_are_bounded(given, depth):
    points, _, p, _ = given
    keyed = boxes.point_cells(p, AXES, [boxes.TILE, 8]).withColumn("_key", F.lit(0)).withColumn("_depth", F.lit(depth))
    blocks = boxes._blocks(keyed, ["_cell", "_level", "_key"], 0.0, 256.0, most=7)
    rows = blocks.select("_level", "_min_x", "_max_x", "_x", "_z", F.col("_p0.value").alias("ids")).collect()
    assert max(len(r["ids"]) for r in rows) == 7 and all(len(r["ids"]) == len(r["_x"]) == len(r["_z"]) for r in rows)
    assert all(r["_min_x"] <= x <= r["_max_x"] for r in rows for x in r["_x"])
    assert sorted((r["_level"], i) for r in rows for i in r["ids"]) == sorted((n, r[0]) for n in (boxes.TILE, 8) for r in points if r[0] not in (503, 504))


def test_lists_of_boxes_are_cut_by_eights(spark):
    b = spark.range(300).selectExpr("id AS box_id", *[f"{v}D AS {c}" for c, v in zip(boxes.BOUNDS, (0, 1) * 3, strict=True)])
    lists = [[r["box_id"] for r in row["_copies"]] for row in boxes.copies(b).collect()]
    assert sorted(map(len, lists)) == [300 % boxes.LISTED, boxes.LISTED, boxes.LISTED] and boxes.LISTED % 8 == 0
    assert sorted(sum(lists, [])) == list(range(300))
