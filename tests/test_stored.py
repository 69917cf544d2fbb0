"""Stored tables: what is read, what is compared, and CRCs of columns."""

import os
import random

import pytest
from pyspark.sql import functions as F

from astrolake.functions import crc, typed
from astrolake.model import Dataset
from astrolake.operators import compare, octree, sampling
from astrolake.sources import bucketed, generator, ranked, shared

AXES = list("xyz")


@pytest.fixture(scope="module")
def box(spark):
    return generator.particles(spark, 200)


@pytest.fixture(scope="module")
def rows(box):
    axes = [F.col(a) for a in AXES]
    return octree.assign_leaf(octree.rank_grid(box.df.drop("_rank"), axes), axes, 2)


@pytest.fixture(scope="module")
def path(box, rows, tmp_path_factory):
    at = f"{tmp_path_factory.mktemp('stored')}/t"
    ranked.write(box.with_df(rows), at, leaf_key="id", block_rows=16)
    return at


def scanned(df):
    """Rows that the scans of data directories gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            if "_row_in_rank" in node.relation().schema().simpleString() or "_percent" in node.relation().schema().simpleString():
                total += node.metrics().apply("numOutputRows").value()
            continue
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_blocks_cover_ranks(spark, rows, path):
    stored = ranked.read(spark, path)
    assert compare.identical(stored.df.select(*rows.columns), rows)
    found = ranked.blocks(spark, path).collect()
    assert all(b["first_row"] % 16 == 0 and b["n_rows"] <= 16 for b in found)
    assert sum(b["n_rows"] for b in found) == rows.count() and len({b["_block"] for b in found}) == len(found)
    files = {f.split("/_block=")[1].split("/")[0] for f in stored.df.inputFiles()}
    assert len(files) == len(found) == len(stored.df.inputFiles())


@pytest.fixture(scope="module")
def coarse(box, rows, tmp_path_factory):
    """The same table and blocks in directories of four blocks."""
    at = f"{tmp_path_factory.mktemp('coarse')}/t"
    ranked.write(box.with_df(rows), at, leaf_key="id", block_rows=16, file_rows=64)
    return at


def test_directories_hold_many_blocks(spark, box, rows, path, coarse, tmp_path):
    assert compare.identical(ranked.blocks(spark, coarse).drop("_held"), ranked.blocks(spark, path).drop("_held"))
    assert compare.identical(ranked.header(spark, coarse), ranked.header(spark, path))
    sizes = [r["n"] for r in box.with_df(rows).ranks().select(F.ceil(F.col("n_rows") / 64).alias("n")).collect()]
    stored = ranked.read(spark, coarse).df
    assert len(stored.inputFiles()) == sum(sizes) < ranked.blocks(spark, coarse).count()
    assert compare.identical(stored.drop("_block"), ranked.read(spark, path).df.drop("_block"))
    for share in (0.0, 0.1, 1.0):
        assert compare.identical(ranked.leaf_prefix(spark, coarse, share).select("id"), ranked.leaf_prefix(spark, path, share).select("id"))
    ranked.register_stored(spark, coarse, "coarse")
    narrow = spark.sql("SELECT id FROM coarse_region(10, 20, 0, 50, 100, 200)")
    assert compare.identical(narrow, octree.region_rows(rows, [F.col(a) for a in AXES], (10.0, 20.0, 0.0, 50.0, 100.0, 200.0)).select("id"))
    assert 0 < scanned(narrow) < rows.count()
    for name, rows_of in (("s", 16), ("f", 64)):
        ranked.write(box, f"{tmp_path}/{name}", shuffled_by="id", block_rows=16, file_rows=rows_of)
    assert compare.identical(ranked.sample(spark, f"{tmp_path}/s", 0.1).select("id"), ranked.sample(spark, f"{tmp_path}/f", 0.1).select("id"))
    assert 0 < scanned(ranked.sample(spark, f"{tmp_path}/f", 0.1)) <= 8 * 64
    with pytest.raises(ValueError):
        ranked.write(box, f"{tmp_path}/w", block_rows=16, file_rows=40)


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_blocks_of_a_directory_are_compared(spark, box, rows, coarse, tmp_path, monkeypatch, few):
    monkeypatch.setattr(ranked, "BROADCAST_BLOCKS", few)
    other = f"{tmp_path}/o"
    wrong = rows.withColumn("phi", F.when(F.col("id").isin(5, 700), -1.0).otherwise(F.col("phi")).cast("float"))
    ranked.write(box.with_df(wrong), other, leaf_key="id", block_rows=16, file_rows=64)
    places = {(r["_rank"], r["_row_in_rank"] // 16 * 16) for r in ranked.read(spark, coarse).df.where("id in (5, 700)").collect()}
    assert {(r["_rank"], r["first_row"]) for r in ranked.differing_blocks(spark, coarse, other).collect()} == places
    assert {r["id"] for r in ranked.differing_rows(spark, coarse, other).collect()} == {5, 700}
    assert ranked.picked_blocks(spark, coarse, ranked.blocks(spark, coarse).where("first_row = 16")).select("_row_in_rank").distinct().count() == 16
    assert ranked.damaged(spark, other).count() == 0
    hit = ranked.read(spark, other).df.where("_rank = 3 AND _row_in_rank BETWEEN 64 AND 127")
    block, kept = hit.first()["_block"], hit.drop("_rank", "_block")
    changed = kept.withColumn("x", F.when(F.col("_row_in_rank") == 77, F.lit(1.5)).otherwise(F.col("x")).cast("float")).collect()
    spark.createDataFrame(changed, kept.schema).coalesce(1).write.mode("overwrite").parquet(f"{other}/_rank=3/_block={block}")
    spark.catalog.refreshByPath(other)
    got = [tuple(r) for r in ranked.damaged(spark, other).select("_rank", "first_row", "last_row").collect()]
    assert len(got) == 1 and got[0][0] == 3 and 64 <= got[0][1] <= 77 <= got[0][2] <= 79


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_files_of_the_catalog_do_not_follow_blocks(spark):
    from astrolake.plans import catalog

    for make in (catalog.stored_octree, catalog.stored_shuffled):
        at = make(spark, "/root/testdata/sf0.01")
        assert len(ranked.read(spark, at).df.inputFiles()) == 8 < ranked.blocks(spark, at).count()


def test_leaf_prefix_reads_less(spark, rows, path):
    got = ranked.leaf_prefix(spark, path, 0.1)
    assert compare.identical(got.select("id"), sampling.leaf_prefix(rows, 0.1, "id", ["_rank", "_leaf"]).select("id"))
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert 0 < scanned(ranked.leaf_prefix(spark, path, 0.1)) < rows.count()
    assert ranked.leaf_prefix(spark, path, 0.0).count() == 0 and ranked.leaf_prefix(spark, path, 1.0).count() == rows.count()


def test_samples_are_prefixes(spark, box, tmp_path):
    at = f"{tmp_path}/s"
    ranked.write(box, at, shuffled_by="id", block_rows=16)
    last = None
    for share in (0.05, 0.3, 0.31, 1.0):
        got = ranked.sample(spark, at, share)
        assert compare.identical(got.select("id", "_rank"), sampling.sample(box.df, share, "id", power=sampling.LINEAR).select("id", "_rank"))
        ids = {r["id"] for r in got.select("id").collect()}
        assert last is None or last <= ids
        last = ids
    assert 0 < scanned(ranked.sample(spark, at, 0.1)) <= 8 * 32
    plan = ranked.sample(spark, at, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_row_in_rank") and "dynamicpruning" in plan
    assert ranked.sample(spark, at, 0.0).count() == 0


def test_region_in_sql(spark, rows, path):
    ranked.register_stored(spark, path, "kept")
    for low, high in ((10.0, 100.0), (0.0, 256.0), (300.0, 400.0)):
        got = spark.sql(f"SELECT * FROM kept_region({low}, {high}, 0, 50, 100, 200)")
        assert "_percent" not in got.columns and "_block" not in got.columns
        assert compare.identical(got.select("id"), octree.region_rows(rows, [F.col(a) for a in AXES], (low, high, 0.0, 50.0, 100.0, 200.0)).select("id"))
    narrow = spark.sql("SELECT id FROM kept_region(10, 20, 0, 50, 100, 200)")
    assert "dynamicpruning" in narrow._jdf.queryExecution().executedPlan().toString()
    assert spark.table("kept").columns == [c for c in rows.columns if c != "_rank"]
    assert compare.identical(spark.sql("SELECT k.id FROM kept_region(0, 256, 0, 256, 0, 256) k JOIN kept USING (id)"), rows.select("id"))


def test_counts_read_no_rows(spark, box, rows, path):
    got = ranked.counts(spark, path)
    assert {(r["_rank"], r["n_rows"], r["rank_offset"]) for r in got.collect()} == {tuple(r) for r in box.with_df(rows).ranks().collect()}
    assert scanned(ranked.counts(spark, path)) == 0
    assert got.agg(F.min("min_x"), F.max("max_z")).first() == rows.agg(F.min("x").cast("double"), F.max("z").cast("double")).first()


def test_differing_blocks(spark, box, rows, path, tmp_path):
    other = f"{tmp_path}/o"
    wrong = rows.withColumn("phi", F.when(F.col("id").isin(5, 700), -1.0).otherwise(F.col("phi")).cast("float"))
    ranked.write(box.with_df(wrong), other, leaf_key="id", block_rows=16)
    places = {(r["_rank"], r["_row_in_rank"] // 16 * 16) for r in ranked.read(spark, path).df.where("id in (5, 700)").collect()}
    got = ranked.differing_blocks(spark, path, other)
    assert {(r["_rank"], r["first_row"]) for r in got.collect()} == places and all(0 <= r["last_row"] - r["first_row"] < 16 for r in got.collect())
    assert scanned(ranked.differing_blocks(spark, path, other)) == 0
    assert {r["id"] for r in ranked.differing_rows(spark, path, other).collect()} == {5, 700}
    assert ranked.differing_blocks(spark, path, path).count() == 0
    # a lost row moves those behind it; the rest of its rank differs, other ranks do not
    less = f"{tmp_path}/l"
    ranked.write(box.with_df(rows.where("id <> 700")), less, leaf_key="id", block_rows=16)
    assert {r["_rank"] for r in ranked.differing_blocks(spark, path, less).collect()} == {r["_rank"] for r in rows.where("id = 700").collect()}
    assert [r["id"] for r in ranked.differing_rows(spark, path, less).collect()] == [700]


def test_damaged_blocks(spark, box, rows, tmp_path):
    at = f"{tmp_path}/d"
    ranked.write(box.with_df(rows), at, leaf_key="id", block_rows=50)
    assert ranked.damaged(spark, at).count() == 0
    hit = ranked.read(spark, at).df.where("_rank = 3 AND _row_in_rank BETWEEN 50 AND 99")
    block = hit.first()["_block"]
    changed = hit.drop("_rank", "_block").withColumn("x", F.when(F.col("_row_in_rank") == 77, F.lit(1.5)).otherwise(F.col("x")).cast("float")).collect()
    spark.createDataFrame(changed, hit.drop("_rank", "_block").schema).coalesce(1).write.mode("overwrite").parquet(f"{at}/_rank=3/_block={block}")
    spark.catalog.refreshByPath(at)
    got = [tuple(r) for r in ranked.damaged(spark, at).select("_rank", "first_row", "last_row").collect()]
    assert len(got) == 1 and got[0][0] == 3 and 50 <= got[0][1] <= 77 <= got[0][2] <= 99


def test_tables_without_roles_or_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", i % 3 if i % 5 else None) for i in range(40)], "k long, t string, part int")
    ranked.write(Dataset(df, rank="part", order=("k",)), f"{tmp_path}/a", block_rows=4)
    assert compare.identical(ranked.read(spark, f"{tmp_path}/a").df.select("k", "t"), df.select("k", "t"))
    assert ranked.counts(spark, f"{tmp_path}/a").agg(F.sum("n_rows")).first()[0] == 40
    ranked.write(Dataset(df.where("false"), rank="part", order=("k",)), f"{tmp_path}/e")
    assert ranked.counts(spark, f"{tmp_path}/e").count() == 0


def test_other_number_of_ranks(box):
    from astrolake.operators import redistribute

    assert redistribute.reranked(box, 8, 8) is box
    for n in (3, 16):
        dealt = redistribute.reranked(box, 8, n)
        assert dealt.roles == {} and compare.identical(dealt.df.select("id"), box.df.select("id"))
        pairs = sorted(tuple(r) for r in dealt.df.select("_source_rank", "_rank").distinct().collect())
        assert len(pairs) == 8 and [p[1] for p in pairs] == sorted(p[1] for p in pairs) and len({p[1] for p in pairs}) == min(n, 8)


def test_header_reads_no_rows(spark, rows, path):
    got = {(r["section"], r["name"]): r["value"] for r in ranked.header(spark, path).collect()}
    assert got["table", "n_rows"] == str(rows.count()) and got["table", "block_rows"] == "16" and got["role", "x"] == "x"
    assert got["column", "_leaf_id"] == "i64" and sum(int(v) for (s, _), v in got.items() if s == "leaf") == rows.count()
    assert scanned(ranked.header(spark, path)) == 0


def test_widened(spark):
    df = spark.createDataFrame([(1, 2, 0.5, [1.0], "t")], "a tinyint, b int, c float, d array<float>, e string")
    got = typed.widened(df)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "double", "double", "string"] and tuple(got.first()) == (1, 2, 0.5, None, "t")


def test_partitions_are_written_by_ranges(spark, box, tmp_path):
    ranked.write_partitioned(box.df, f"{tmp_path}/p", F.lit(0), file_rows=100)
    assert len(spark.read.parquet(f"{tmp_path}/p").inputFiles()) >= 8
    assert ranked.read_rank(spark, f"{tmp_path}/p", 4).count() == 200


def test_samples_scan_keys_and_filter(box):
    plan = sampling.sample(box.df, 0.3, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Window" not in plan


@pytest.mark.parametrize("groups", [1 << 16, 0])
def test_first_shuffled_by_join(spark, monkeypatch, groups):
    monkeypatch.setattr(sampling, "BROADCAST_GROUPS", groups)
    rng = random.Random(1)
    df = spark.createDataFrame([(i, None if (g := rng.randrange(6)) == 5 else g) for i in range(3000)], "id long, _rank int")
    got = sampling.sample(df, 0.4, "id", power=sampling.LINEAR).groupBy("_rank").count()
    sizes = {r["_rank"]: r["count"] for r in df.groupBy("_rank").count().collect()}
    assert {r["_rank"]: r["count"] for r in got.collect()} == {k: int(n * 0.4 + 0.5) for k, n in sizes.items()}


def test_buckets_are_compared_in_place(spark, tmp_path):
    rng = random.Random(4)
    a = [(i % 500, rng.randrange(3), f"v{i}") for i in range(700)]
    b = [r for i, r in enumerate(a) if i % 90] + [(9, 9, "new"), (10_000, 1, "new"), a[3], a[3]]
    kinds = "k int, u int, v string"
    names = []
    for name, part in (("x", a), ("y", b)):
        names.append(f"bucket_{name}")
        bucketed.write(spark.createDataFrame(part, kinds).repartition(3), names[-1], f"{tmp_path}/{name}", "k", 4)
    got = bucketed.differing_keys(spark, *names, "k")
    of = lambda rows, k: sorted(r for r in rows if r[0] == k)
    want = {(k, len(of(a, k)), len(of(b, k))) for k in {r[0] for r in a + b} if of(a, k) != of(b, k)}
    assert {tuple(r) for r in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = bucketed.differing_rows(spark, *names, "k")
    assert compare.identical(rows, spark.createDataFrame(a, kinds).exceptAll(spark.createDataFrame(b, kinds)))
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def test_buckets_follow_rows(spark, monkeypatch):
    from astrolake.plans import catalog

    assert bucketed.buckets_for(spark.range(5), spark.range(0)) == 8
    monkeypatch.setattr(bucketed, "BUCKET_ROWS", 100)
    assert bucketed.buckets_for(spark.range(5), spark.range(1201)) == 13
    orders = spark.range(1500).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.col("id").cast("double").alias("o_totalprice"))
    monkeypatch.setattr(catalog, "table", lambda spark, d, name: orders)
    got = catalog.stored_compare(spark, "of 1500 orders")
    assert got.count() == sum(i % 100 == 7 or i % 50 == 3 for i in range(1500))
    kept = [t.name for t in spark.catalog.listTables() if t.name.startswith(("stored_first_", "stored_second_"))]
    told = [{r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {t}").collect()}.get("Num Buckets") for t in kept]
    assert told.count("15") == 2


def test_crc_of_pieces():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 8, 9, 1000, 4097):
        data = rng.integers(0, 256, n).astype(np.uint8)
        assert crc.finished(crc.piece(data), n) == typed.crc64_of(data.tobytes())
        cuts = np.sort(rng.integers(0, n + 1, 5))
        parts = np.split(data, cuts)
        whole, length = crc.joined(np.array([crc.piece(p) for p in parts], np.uint64), np.array([len(p) for p in parts]))
        assert (whole, length) == (crc.piece(data), n)


@pytest.mark.parametrize("parts,fan", [(1, 1 << 14), (7, 1 << 14), (5, 1)])
def test_column_crc(spark, parts, fan, monkeypatch):
    rng = random.Random(parts)
    rows = [(r, p, rng.randrange(-(2**40), 2**40), rng.random(), rng.choice([None, "", "é text", "x" * 30]), rng.randrange(100)) for r in range(3) for p in range(1500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "_rank int, _row_in_rank long, a long, b float, c string, d short").repartition(parts)
    import numpy as np

    kinds = {"a": "<i8", "b": "<f4", "d": "<i2"}
    for column, i in (("a", 2), ("b", 3), ("c", 4), ("d", 5)):
        got = {r["_rank"]: (r["n_rows"], r["n_bytes"], int(r["crc"])) for r in crc.column_crc(df, column, fan=fan).collect()}
        for rank in range(3):
            values = [r[i] for r in sorted(rows, key=lambda r: r[:2]) if r[0] == rank]
            data = b"".join((v or "").encode() for v in values) if column == "c" else np.array(values, kinds[column]).tobytes()
            assert got[rank] == (1500, len(data), typed.crc64_of(data))
    assert crc.column_crc(df.where("false"), "a").count() == 0


def test_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        def get(self, name, *default):
            return default[0] if name == "spark.checkpoint.dir" else "file:/here"

    class Context:
        master = "spark://elsewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared.shared_folder(Session())
    Context.master = "local[4]"
    assert shared.shared_folder(Session()) == "file:/here/_intermediate"
    made = []
    shared.written(spark.range(3), "some", made)
    at = made[0]
    assert shared.exists(spark, at)
    shared.drop(spark, made)
    assert not shared.exists(spark, at) and made == []
