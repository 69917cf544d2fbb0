"""Registered queries on the driver's tables, each with the same question in DuckDB SQL.

``particles`` is a view of ``orders``: unique ids, coordinates on a grid of hundredths in
a box of 256, and the rank of a 2 x 2 x 2 split.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.functions import crc, typed
from astrolake.model import Dataset, percent_slice
from astrolake.operators import adaptive, boxes, compare, octree, redistribute, sampling
from astrolake.sources import bucketed, export, growing, ranked
from astrolake.sources.shared import drop, exists, shared_folder
from astrolake.streaming import changes
from astrolake.operators.selection import AT_LEAST, AT_MOST, BETWEEN, IS, Selection, in_box, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

AXES = ["x", "y", "z"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def axes():
    return [F.col(a) for a in AXES]


def particles(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """id, x, y, z, further columns of orders, _cx, _cy, _cz, _rank."""
    o = table(spark, sf_dir, "orders")
    p = o.select(
        F.col("o_orderkey").alias("id"),
        (F.pmod(F.col("o_orderkey") * 7919, F.lit(25600)).cast("double") / 100.0).alias("x"),
        (F.pmod(F.col("o_custkey") * 104729, F.lit(25600)).cast("double") / 100.0).alias("y"),
        (F.pmod(F.floor("o_totalprice").cast("long"), F.lit(25600)).cast("double") / 100.0).alias("z"),
        *more,
    )
    return octree.rank_grid(p, axes())


PARTICLES = """particles AS (
  SELECT *, (_cx * 4 + _cy * 2 + _cz)::int AS _rank FROM (
    SELECT *, floor(x / 128)::int AS _cx, floor(y / 128)::int AS _cy, floor(z / 128)::int AS _cz FROM (
      SELECT o_orderkey AS id, ((o_orderkey * 7919) % 25600)::double / 100.0::double AS x,
             ((o_custkey * 104729) % 25600)::double / 100.0::double AS y,
             (floor(o_totalprice)::bigint % 25600)::double / 100.0::double AS z FROM orders)))"""

#: Two levels: eight leaves of 64 units in each rank, x first; the periodic faces wrap.
LEAVES = (
    PARTICLES
    + """, leaves AS (
  SELECT *, (lx * 4 + ly * 2 + lz)::int AS _leaf, (_rank * 8 + lx * 4 + ly * 2 + lz)::int AS _leaf_id FROM (
    SELECT *, least(floor((x - _cx * 128) / 64), 1)::int AS lx, least(floor((y - _cy * 128) / 64), 1)::int AS ly, least(floor((z - _cz * 128) / 64), 1)::int AS lz FROM particles))"""
)

EVENTS = "ranked AS (SELECT *, (user_id % 8)::int AS _rank FROM events)"

EXTENDED = (
    EVENTS
    + """, extended AS (
  SELECT *, (row_number() OVER (PARTITION BY _rank ORDER BY event_id) - 1)::bigint AS _row_in_rank,
         count(*) OVER (PARTITION BY _rank) AS _rank_rows,
         row_number() OVER (ORDER BY _rank, event_id) AS _rowid FROM ranked),
  percents AS (SELECT *, _row_in_rank::double / _rank_rows AS _percent FROM extended)"""
)


def events(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(table(spark, sf_dir, "events").withColumn("_rank", F.pmod(F.col("user_id"), F.lit(8)).cast("int")), order=("event_id",))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of two levels; their numbers are small."""
    found = octree.assign_leaf(particles(spark, sf_dir), axes(), 2)
    return found.withColumns({c: F.col(c).cast("int") for c in ("_leaf", "_leaf_id")})


def query(sql: str | None = None):
    """Register a query with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# scans, projections, filters


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_project(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def filter_project_cookbook(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 400000").select("o_orderkey", "o_totalprice")


@query(f"WITH {PARTICLES} SELECT id, x FROM particles WHERE _rank = 3")
def filter_is(spark, d):
    return load(particles(spark, d), ["id", "x"], [], Selection().add("_rank", IS, 3))


@query(f"WITH {PARTICLES} SELECT id, x FROM particles WHERE x >= 200.5")
def filter_ge(spark, d):
    return load(particles(spark, d), ["id", "x"], [], Selection().add("x", AT_LEAST, 200.5))


@query(f"WITH {PARTICLES} SELECT id, y FROM particles WHERE y <= 10.25")
def filter_le(spark, d):
    return load(particles(spark, d), ["id", "y"], [], Selection().add("y", AT_MOST, 10.25))


@query(f"WITH {PARTICLES} SELECT id, z FROM particles WHERE z BETWEEN 50 AND 60")
def filter_between(spark, d):
    return load(particles(spark, d), ["id", "z"], [], Selection().add("z", BETWEEN, 50, 60))


@query(f"WITH {PARTICLES} SELECT x, y, z, id FROM particles WHERE x >= 64 AND y <= 200 AND z BETWEEN 20 AND 220")
def filter_and_chain(spark, d):
    chosen = Selection().add("x", AT_LEAST, 64).add("y", AT_MOST, 200).add("unknown", IS, 1).add("z", BETWEEN, 20, 220)
    return load(particles(spark, d), ["id"], AXES, chosen)


@query(f"WITH {PARTICLES} SELECT id FROM particles WHERE false")
def filter_unknown_only(spark, d):
    return load(particles(spark, d), ["id"], [], Selection().add("unknown", IS, 1))


@query(f"WITH {EVENTS} SELECT event_id, _rank FROM ranked WHERE _rank = 5")
def rank_filter_eq(spark, d):
    return events(spark, d).df.where("_rank = 5").select("event_id", "_rank")


@query(f"WITH {EVENTS} SELECT event_id, _rank FROM ranked WHERE _rank > 1.5 AND _rank <= 4")
def rank_filter_range(spark, d):
    return events(spark, d).df.where("_rank > 1.5D AND _rank <= 4").select("event_id", "_rank")


@query(f"WITH {PARTICLES} SELECT id FROM particles WHERE x >= 10 AND x < 74 AND y >= 20 AND y < 148 AND z >= 0 AND z < 256")
def point_in_box_halfopen(spark, d):
    return particles(spark, d).where(in_box(axes(), [10, 20, 0], [74, 148, 256])).select("id")


@query(f"WITH {PARTICLES} SELECT id FROM particles WHERE x BETWEEN 10 AND 74 AND y BETWEEN 20 AND 148 AND z BETWEEN 0 AND 128")
def point_in_box_inclusive(spark, d):
    return particles(spark, d).where(in_box(axes(), [10, 20, 0], [74, 148, 128], closed=True)).select("id")


# positions, percents, row ids


@query(f"WITH {EXTENDED} SELECT event_id, _rank, _percent FROM percents WHERE _percent < 0.1")
def percent_slice_low(spark, d):
    return percent_slice(events(spark, d).extended(), high=0.1).select("event_id", "_rank", "_percent")


@query(f"WITH {EXTENDED} SELECT event_id, _rank, _percent FROM percents WHERE _percent >= 0.25 AND _percent <= 0.5")
def percent_band(spark, d):
    return percent_slice(events(spark, d).extended(), 0.25, 0.5, high_open=False).select("event_id", "_rank", "_percent")


@query(f"WITH {EXTENDED} SELECT event_id FROM percents WHERE false")
def percent_out_of_range(spark, d):
    return percent_slice(events(spark, d).extended(), 0.8, 0.2).select("event_id")


@query(f"WITH {LEAVES} SELECT id, _leaf_id, p AS _percent FROM (SELECT *, (row_number() OVER (PARTITION BY _rank, _leaf_id ORDER BY id) - 1)::double / count(*) OVER (PARTITION BY _rank, _leaf_id) AS p FROM leaves) WHERE p < 0.2")
def percent_by_leaf(spark, d):
    return percent_slice(Dataset(leaves(spark, d)).extended("_leaf_id"), high=0.2).select("id", "_leaf_id", "_percent")


@query(f"WITH {EXTENDED} SELECT event_id, _rank, _row_in_rank, _rank_rows, _rowid FROM percents")
def rowid_global(spark, d):
    return events(spark, d).extended().select("event_id", "_rank", "_row_in_rank", "_rank_rows", "_rowid")


@query(f"WITH {EXTENDED} SELECT event_id, _rowid FROM percents WHERE _rank >= 3 AND value > 50")
def rowid_stable_under_filter(spark, d):
    return events(spark, d).extended().where("_rank >= 3 AND value > 50").select("event_id", "_rowid")


@query(f"WITH {EXTENDED} SELECT event_id, _row_in_rank FROM percents WHERE _rank = 2 AND _row_in_rank BETWEEN 100 AND 149")
def row_range_scan(spark, d):
    from astrolake.sources.ranked import row_range

    return row_range(events(spark, d).extended(), 2, 100, 50).select("event_id", "_row_in_rank")


# counts and offsets


@query("SELECT count(*) AS n FROM events")
def count_all(spark, d):
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS} SELECT _rank, count(*) AS n FROM ranked GROUP BY _rank")
def count_by_rank(spark, d):
    return events(spark, d).df.groupBy("_rank").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS} SELECT max(n) AS max_rows FROM (SELECT count(*) AS n FROM ranked GROUP BY _rank)")
def max_rows_per_rank(spark, d):
    return events(spark, d).ranks().agg(F.max("n_rows").alias("max_rows"))


@query(f"WITH {EVENTS} SELECT _rank, n AS n_rows, (coalesce(sum(n) OVER (ORDER BY _rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS rank_offset FROM (SELECT _rank, count(*) AS n FROM ranked GROUP BY _rank)")
def rank_offsets(spark, d):
    return events(spark, d).ranks()


@query(f"WITH {EVENTS} SELECT count(DISTINCT _rank) AS n_partitions FROM ranked")
def distinct_partitions(spark, d):
    return events(spark, d).df.agg(F.countDistinct("_rank").alias("n_partitions"))


# octree


@query(f"WITH {LEAVES} SELECT id, _rank, _leaf, _leaf_id FROM leaves")
def leaf_assign(spark, d):
    return leaves(spark, d).select("id", "_rank", "_leaf", "_leaf_id")


@query(f"""WITH {PARTICLES}, c AS (SELECT id, _rank, floor((x - _cx * 128) / 32)::int AS a, floor((y - _cy * 128) / 32)::int AS b, floor((z - _cz * 128) / 32)::int AS c FROM particles)
SELECT id, (_rank * 64 + (a // 2) * 32 + (b // 2) * 16 + (c // 2) * 8 + (a % 2) * 4 + (b % 2) * 2 + c % 2)::int AS _leaf_id FROM c""")
def leaf_assign_three_levels(spark, d):
    return octree.assign_leaf(particles(spark, d), axes(), 3).select("id", F.col("_leaf_id").cast("int").alias("_leaf_id"))


@query(f"WITH {LEAVES} SELECT _leaf_id, count(*) AS n_rows FROM leaves GROUP BY _leaf_id")
def leaf_histogram(spark, d):
    return leaves(spark, d).groupBy("_leaf_id").agg(F.count(F.lit(1)).alias("n_rows"))


LEAF_TABLE = f"""WITH {LEAVES}, counted AS (SELECT _leaf_id, _rank, _leaf, _cx, _cy, _cz, lx, ly, lz, count(*) AS n_rows FROM leaves GROUP BY ALL),
leaf_table AS (SELECT _leaf_id, _rank, _leaf, n_rows,
  (_cx * 128 + lx * 64)::double AS min_x, (_cx * 128 + lx * 64 + 64)::double AS max_x, (_cy * 128 + ly * 64)::double AS min_y, (_cy * 128 + ly * 64 + 64)::double AS max_y,
  (_cz * 128 + lz * 64)::double AS min_z, (_cz * 128 + lz * 64 + 64)::double AS max_z,
  (coalesce(sum(n_rows) OVER (PARTITION BY _rank ORDER BY _leaf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS row_offset FROM counted)
"""


@query(LEAF_TABLE + "SELECT * FROM leaf_table")
def leaf_table(spark, d):
    return octree.leaf_table(leaves(spark, d), 2)


@query(LEAF_TABLE + "SELECT _leaf_id, round(min_x)::bigint AS min_x, round(max_x)::bigint AS max_x, n_rows FROM leaf_table")
def leaf_table_integer(spark, d):
    return octree.integer_boxes(octree.leaf_table(leaves(spark, d), 2)).select("_leaf_id", "min_x", "max_x", "n_rows")


REGION = (64.0, 128.0, 0.0, 63.5, 190.0, 256.0)


@query(LEAF_TABLE + "SELECT _leaf_id, n_rows FROM leaf_table WHERE 64 < max_x AND 128 >= min_x AND 0 < max_y AND 63.5 >= min_y AND 190 < max_z AND 256 >= min_z")
def region_leaves(spark, d):
    return octree.region_leaves(octree.leaf_table(leaves(spark, d), 2), REGION).select("_leaf_id", "n_rows")


@query(f"WITH {PARTICLES} SELECT id, x, y, z FROM particles WHERE x BETWEEN 64 AND 128 AND y BETWEEN 0 AND 63.5 AND z BETWEEN 190 AND 256")
def region_rows(spark, d):
    return octree.region_rows(particles(spark, d), axes(), REGION).select("id", "x", "y", "z")


@query(f"WITH {LEAVES} SELECT id, x, y, z FROM leaves WHERE _leaf_id IN (12, 13) AND x >= 64")
def leaf_rows(spark, d):
    return leaves(spark, d).where("_leaf_id IN (12, 13) AND x >= 64").select("id", "x", "y", "z")


@query(f"WITH {PARTICLES} SELECT id, o_totalprice AS mass, x, y, z FROM particles JOIN orders ON id = o_orderkey WHERE x BETWEEN 64 AND 128 AND y BETWEEN 0 AND 63.5 AND z BETWEEN 190 AND 256 AND o_totalprice > 100000")
def region_halo_extract(spark, d):
    halos = particles(spark, d, F.col("o_totalprice").alias("mass")).where("mass > 100000")
    return octree.region_rows(halos, axes(), REGION).select("id", "mass", "x", "y", "z")


@query(f"""WITH {PARTICLES}, p AS (SELECT id, round(x / 64) * 64 AS x, (id % 2) * 128.0::double AS low FROM particles)
SELECT id, x, low, CASE WHEN x = 0 AND low = 128 THEN 256 WHEN x = 256 AND low = 0 THEN 0 ELSE x END::double AS wrapped FROM p""")
def periodic_wrap(spark, d):
    points = particles(spark, d).select("id", (F.round(F.col("x") / 64) * 64).alias("x"), (F.pmod("id", F.lit(2)) * 128).cast("double").alias("low"))
    return points.withColumn("wrapped", octree.wrap(F.col("x"), F.col("low"), F.col("low") + 128, 0.0, 256.0))


@query(f"""WITH {LEAVES}, moved AS (SELECT *, CASE WHEN id % 100 = 7 THEN (_leaf + 1) % 8 ELSE _leaf END AS wrong FROM leaves),
boxes AS (SELECT *, _cx * 128 + (wrong // 4) * 64 AS ax, _cy * 128 + (wrong // 2 % 2) * 64 AS ay, _cz * 128 + (wrong % 2) * 64 AS az FROM moved)
SELECT id FROM boxes WHERE x < ax OR x > ax + 64 OR y < ay OR y > ay + 64 OR z < az OR z > az + 64""")
def verify_octree_violations(spark, d):
    moved = leaves(spark, d).withColumn("_leaf", F.when(F.pmod("id", F.lit(100)) == 7, F.pmod(F.col("_leaf") + 1, F.lit(8))).otherwise(F.col("_leaf")).cast("int"))
    return octree.violations(moved, axes(), 2).select("id")


@query(LEAF_TABLE + "SELECT _rank, count(*) AS n_leaves, min(row_offset) AS first_row, (sum(n_rows))::bigint AS n_rows FROM leaf_table GROUP BY _rank")
def leaves_by_rank(spark, d):
    return octree.leaf_table(leaves(spark, d), 2).groupBy("_rank").agg(F.count(F.lit(1)).alias("n_leaves"), F.min("row_offset").alias("first_row"), F.sum("n_rows").alias("n_rows"))


# samples

def _sample_sql(source: str, name: str, key: str, share: float, more: str = "") -> str:
    return f"""WITH {source}, s AS (SELECT *, row_number() OVER (PARTITION BY _rank ORDER BY md5('0:' || {key}::varchar), {key}) AS k, count(*) OVER (PARTITION BY _rank) AS n FROM {name})
SELECT {key}, _rank FROM s WHERE k <= round(n * {share}::double) {more}"""


@query(_sample_sql(EVENTS, "ranked", "event_id", 0.05))
def sample_linear(spark, d):
    return sampling.sample(events(spark, d).df, 0.05, "event_id", power=sampling.LINEAR).select("event_id", "_rank")


@query(_sample_sql(EVENTS, "ranked", "event_id", 0.3**3))
def sample_cube(spark, d):
    return sampling.sample(events(spark, d).df, 0.3, "event_id").select("event_id", "_rank")


@query(_sample_sql(EVENTS, "ranked", "event_id", 0.2, "AND event_type = 'click'"))
def sample_then_filter(spark, d):
    return sampling.sample_then(events(spark, d).df, 0.2, "event_id", F.col("event_type") == "click", power=sampling.LINEAR).select("event_id", "_rank")


@query(f"""WITH {LEAVES}, s AS (SELECT *, row_number() OVER (PARTITION BY _rank, _leaf ORDER BY md5('0:' || id::varchar), id) - 1 AS k, count(*) OVER (PARTITION BY _rank, _leaf) AS n FROM leaves)
SELECT id, _leaf_id FROM s WHERE k < floor(n * 0.1::double)""")
def sample_leaf_prefix(spark, d):
    return sampling.leaf_prefix(leaves(spark, d), 0.1, "id", ["_rank", "_leaf"]).select("id", "_leaf_id")


# exchange


@query(f"WITH {EVENTS} SELECT _rank, (CASE WHEN _rank < 2 THEN _rank // 2 ELSE 1 + (_rank - 2) // 3 END)::int AS reader FROM ranked GROUP BY _rank")
def redistribute_blocks_tail(spark, d):
    return events(spark, d).df.select("_rank").distinct().withColumn("reader", redistribute.blocks_tail(F.col("_rank"), 8, 3))


@query(f"WITH {EVENTS} SELECT _rank, (CASE WHEN _rank < 6 THEN _rank // 3 ELSE 2 + (_rank - 6) // 2 END)::int AS reader FROM ranked GROUP BY _rank")
def redistribute_blocks_head(spark, d):
    return events(spark, d).df.select("_rank").distinct().withColumn("reader", redistribute.blocks_head(F.col("_rank"), 8, 3))


@query(f"WITH {EVENTS} SELECT _rank, (least(_rank // 2, 2))::int AS reader FROM ranked GROUP BY _rank")
def redistribute_blocks_last(spark, d):
    return events(spark, d).df.select("_rank").distinct().withColumn("reader", redistribute.blocks_last(F.col("_rank"), 8, 3))


@query(f"WITH {PARTICLES} SELECT DISTINCT _rank, _cx * 128.0::double AS min_x, (_cx + 1) * 128.0::double AS max_x, _cy * 128.0::double AS min_y, (_cy + 1) * 128.0::double AS max_y, _cz * 128.0::double AS min_z, (_cz + 1) * 128.0::double AS max_z FROM particles")
def rank_extents(spark, d):
    return redistribute.regions(particles(spark, d).select("_rank", "_cx", "_cy", "_cz").distinct()).drop("_cx", "_cy", "_cz")


@query(f"WITH {PARTICLES} SELECT trunc(min(x))::int AS min_x, trunc(max(x))::int AS max_x, trunc(min(y))::int AS min_y, trunc(max(y))::int AS max_y, trunc(min(z))::int AS min_z, trunc(max(z))::int AS max_z FROM particles")
def minmax_extents(spark, d):
    return particles(spark, d).agg(*[f(a).cast("int").alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


# comparison


def _changed(spark, d) -> tuple[DataFrame, DataFrame]:
    a = particles(spark, d).select("id", "x", "_rank")
    return a, a.where(F.pmod("id", F.lit(100)) != 7).withColumn("x", F.when(F.pmod("id", F.lit(50)) == 3, F.col("x") + 1).otherwise(F.col("x")))


_CHANGED = f"{PARTICLES}, a AS (SELECT id, x, _rank FROM particles), b AS (SELECT id, CASE WHEN id % 50 = 3 THEN x + 1 ELSE x END AS x, _rank FROM a WHERE id % 100 <> 7)"


@query(f"WITH {_CHANGED} SELECT * FROM a EXCEPT ALL SELECT * FROM b")
def compare_missing_rows(spark, d):
    return compare.missing(*_changed(spark, d))


@query(f"WITH {_CHANGED} SELECT _rank, n_a, coalesce(n_b, 0) AS n_b, n_a - coalesce(n_b, 0) AS difference FROM (SELECT _rank, count(*) AS n_a FROM a GROUP BY _rank) LEFT JOIN (SELECT _rank, count(*) AS n_b FROM b GROUP BY _rank) USING (_rank)")
def compare_counts(spark, d):
    return compare.row_counts(*_changed(spark, d))


@query(f"WITH {_CHANGED} SELECT DISTINCT _rank FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))")
def verify_ranks(spark, d):
    a, b = _changed(spark, d)
    return compare.verify(compare.digest(a), compare.digest(b))


# vectors, types, digests


@query("SELECT vec_id, embedding[1] AS \"embedding.x\", embedding[2] AS \"embedding.y\", embedding[3] AS \"embedding.z\", embedding[4] AS \"embedding.w\", embedding[5] AS \"embedding.w1\" FROM embeddings")
def vector_flatten(spark, d):
    return typed.flatten_vector(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 5)


@query("SELECT vec_id, len(embedding)::int AS n_fields FROM embeddings")
def vector_field_count(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("n_fields"))


@query("""SELECT * FROM (VALUES (0, 'l_orderkey', 'i64'), (1, 'l_partkey', 'i64'), (2, 'l_suppkey', 'i64'), (3, 'l_linenumber', 'i32'), (4, 'l_quantity', 'f64'), (5, 'l_extendedprice', 'f64'), (6, 'l_discount', 'f64'),
  (7, 'l_tax', 'f64'), (8, 'l_returnflag', 'string'), (9, 'l_linestatus', 'string'), (10, 'l_shipdate', 'timestamp_ntz')) t("position", name, label)""")
def type_label_table(spark, d):
    return typed.schema_table(table(spark, d, "lineitem")).drop("role")


_STEPS = ", ".join(f"t{k + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 14514072000185962306::ubigint) ELSE c >> 1 END AS c FROM t{k})" for k in range(8))
#: The CRC of a list of bytes ``b``, from the table ``t`` of 256 words.
_CRC_OF = "xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255)::bigint + 1], c >> 8), 18446744073709551615::ubigint), 18446744073709551615::ubigint)"
_CRC_TABLE = f"t0 AS (SELECT i::ubigint AS i, i::ubigint AS c FROM range(256) r(i)), {_STEPS}, tbl AS (SELECT list(c ORDER BY i) AS t FROM t8)"


@query(f"""WITH {_CRC_TABLE}, texts AS (SELECT o_orderkey, list_transform(range(1, length(o_orderpriority) + 1), lambda i: ord(substr(o_orderpriority, i, 1))::ubigint) AS b FROM orders)
SELECT o_orderkey, ({_CRC_OF})::decimal(20,0) AS crc FROM texts, tbl""")
def crc64_digest(spark, d):
    return table(spark, d, "orders").select("o_orderkey", typed.crc64(F.col("o_orderpriority").cast("binary")).alias("crc"))


@query(f"WITH {PARTICLES} SELECT x::float AS x, 0::float AS vx, y::float AS y, 0::float AS vy, z::float AS z, 0::float AS vz, 0::float AS phi, id FROM particles")
def row_major_export_columns(spark, d):
    zero = F.lit(0).cast("float")
    return particles(spark, d).select(F.col("x").cast("float").alias("x"), zero.alias("vx"), F.col("y").cast("float").alias("y"), zero.alias("vy"), F.col("z").cast("float").alias("z"), zero.alias("vz"), zero.alias("phi"), "id")


@query("SELECT event_id, concat_ws(chr(9), event_id::varchar, user_id::varchar, event_type) AS line FROM events")
def print_rows(spark, d):
    from astrolake.sources.export import table_lines

    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return table_lines(e).select(F.split("value", "\t")[0].cast("long").alias("event_id"), F.col("value").alias("line"))


@query(f"WITH {PARTICLES} SELECT id, printf('%g', x) AS x_text, printf('%g', x * 12345.678::double) AS large, printf('%g', -x / 1e7::double) AS small FROM particles")
def value_text(spark, d):
    p = particles(spark, d)
    return p.select("id", typed.to_text(F.col("x")).alias("x_text"), typed.to_text(F.col("x") * 12345.678).alias("large"), typed.to_text(-F.col("x") / 1e7).alias("small"))


@query(f"WITH {PARTICLES}, r AS (SELECT _rank, count(*) AS n, min(x) AS a, max(x) AS b FROM particles GROUP BY _rank) SELECT sum(n)::bigint AS n_rows, count(*) AS n_ranks, max(n) AS max_rank_rows, 8::int AS n_columns, min(a) AS min_x, max(b) AS max_x FROM r")
def file_info(spark, d):
    return typed.file_info(particles(spark, d), boxes=["x"])


@query(f"WITH {PARTICLES} SELECT id, x::float AS px, y::float AS py, z::float AS pz FROM particles")
def point_assembly(spark, d):
    return Dataset(particles(spark, d)).points("id").select("id", F.col("point.x").alias("px"), F.col("point.y").alias("py"), F.col("point.z").alias("pz"))


@query(f"WITH {EVENTS} SELECT _rank, floor(count(*) * 0.1::double)::bigint AS n_shown FROM ranked GROUP BY _rank")
def rows_to_show(spark, d):
    return events(spark, d).rows_to_show(0.1)


@query("SELECT string_agg(n_name, ',' ORDER BY n_name) AS names, n_regionkey FROM nation GROUP BY n_regionkey")
def group_concat(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT o_orderstatus, round(avg(o_totalprice), 2) AS mean, round(coalesce(sum(CASE WHEN o_totalprice > 1e9 THEN o_totalprice END), 0.0::double), 2)::double AS total FROM orders GROUP BY o_orderstatus")
def avg_and_total(spark, d):
    huge = F.sum(F.when(F.col("o_totalprice") > 1e9, F.col("o_totalprice")))
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 2).alias("mean"), F.round(F.coalesce(huge, F.lit(0.0)), 2).alias("total"))


# stored tables: written, then read back with what the layout allows to skip


_making = threading.RLock()


def stored(spark: SparkSession, d: str, name: str, last: str, make: Callable[[str], None]) -> str:
    """Path of a table that a session's queries share: made once, ``last`` being what is written last."""
    told = hashlib.md5(f"{spark.sparkContext.applicationId}:{d}".encode()).hexdigest()[:16]
    path = f"{shared_folder(spark)}/catalog-{name}-{told}"
    with _making:
        if not exists(spark, f"{path}/{last}"):
            drop(spark, [path])
            make(path)
    return path


#: Rows of a block of the tables stored here, which the SQL of some queries fixes, and of a directory, which holds many of them.
SMALL_BLOCK, FILE_ROWS = 256, 1 << 20


def stored_octree(spark: SparkSession, d: str) -> str:
    return stored(spark, d, "octree", "_table", lambda path: ranked.write(Dataset(leaves(spark, d)), path, leaf_key="id", block_rows=SMALL_BLOCK, file_rows=FILE_ROWS))


@query(f"WITH {PARTICLES} SELECT id, x, y, z FROM particles WHERE x BETWEEN 64 AND 128 AND y BETWEEN 0 AND 63.5 AND z BETWEEN 190 AND 256")
def stored_region_rows(spark, d):
    return ranked.region(spark, stored_octree(spark, d), REGION).select("id", "x", "y", "z")


@query(f"WITH {LEAVES} SELECT id, x, y, z FROM leaves WHERE _leaf_id = 13")
def stored_leaf_read(spark, d):
    return ranked.leaf(spark, stored_octree(spark, d), 13).select("id", "x", "y", "z")


STORED = f"""WITH {LEAVES}, stored AS (SELECT *, row_number() OVER (PARTITION BY _rank ORDER BY _leaf_id, md5('0:' || id::varchar), id) - 1 AS k, count(*) OVER (PARTITION BY _rank) AS n FROM leaves)"""


@query(STORED + " SELECT id, k::bigint AS _row_in_rank FROM stored WHERE _rank = 2 AND k BETWEEN 40 AND 89")
def stored_row_range(spark, d):
    return ranked.row_range(ranked.read(spark, stored_octree(spark, d)).df, 2, 40, 50).select("id", "_row_in_rank")


@query(STORED + " SELECT id, k / n::double AS _percent FROM stored WHERE k / n::double < 0.1")
def stored_percent(spark, d):
    return percent_slice(ranked.read(spark, stored_octree(spark, d)).df, high=0.1).select("id", "_percent")


@query(STORED + " SELECT _rank, _leaf_id, min(k)::bigint AS row_offset, count(*) AS n_rows, min(x) AS min_x, max(x) AS max_x FROM stored GROUP BY _rank, _leaf_id")
def stored_leaf_table(spark, d):
    return ranked.leaves(spark, stored_octree(spark, d)).select("_rank", "_leaf_id", "row_offset", "n_rows", "min_x", "max_x")


def stored_partitions(spark: SparkSession, d: str) -> str:
    return stored(spark, d, "partitioned", "_ranks", lambda path: ranked.write_partitioned(events(spark, d).df, path, redistribute.blocks_head(F.col("_rank"), 8, 3)))


@query(f"WITH {EVENTS} SELECT _rank, CASE WHEN _rank < 6 THEN _rank // 3 ELSE 2 + (_rank - 6) // 2 END::int AS _partition, count(*) AS n_rows FROM ranked GROUP BY _rank")
def stored_rank_map(spark, d):
    return ranked.rank_map(spark, stored_partitions(spark, d))


@query(f"WITH {EVENTS} SELECT event_id, _rank FROM ranked WHERE _rank = 4")
def stored_rank_read(spark, d):
    return ranked.read_rank(spark, stored_partitions(spark, d), 4).select("event_id", "_rank")


@query(f"WITH {EXTENDED} SELECT event_id, _rowid FROM percents WHERE _percent < 0.2 AND _rank = 1")
def stored_view_sql(spark, d):
    path = stored(spark, d, "view", "_table", lambda path: ranked.write(events(spark, d), path))
    ranked.register(ranked.read(spark, path), "stored_events")
    return spark.sql("SELECT event_id, _rowid FROM stored_events_extended WHERE _percent < 0.2 AND _rank = 1")


@query(f"WITH {PARTICLES} SELECT id, x, y, z FROM particles WHERE x BETWEEN 64 AND 128 AND y BETWEEN 0 AND 63.5 AND z BETWEEN 190 AND 256")
def stored_view_region(spark, d):
    ranked.register_stored(spark, stored_octree(spark, d), "stored_particles")
    return spark.sql("SELECT id, x, y, z FROM stored_particles_region(64, 128, 0, 63.5, 190, 256)")


@query(f"""WITH {LEAVES}, s AS (SELECT *, row_number() OVER (PARTITION BY _rank, _leaf ORDER BY md5('0:' || id::varchar), id) - 1 AS k, count(*) OVER (PARTITION BY _rank, _leaf) AS n FROM leaves)
SELECT id, _leaf_id FROM s WHERE k < floor(n * 0.1::double)""")
def stored_leaf_prefix(spark, d):
    return ranked.leaf_prefix(spark, stored_octree(spark, d), 0.1).select("id", "_leaf_id")


def stored_shuffled(spark: SparkSession, d: str) -> str:
    return stored(spark, d, "shuffled", "_table", lambda path: ranked.write(events(spark, d), path, shuffled_by="event_id", block_rows=SMALL_BLOCK, file_rows=FILE_ROWS))


@query(_sample_sql(EVENTS, "ranked", "event_id", 0.3**3))
def stored_sample(spark, d):
    return ranked.sample(spark, stored_shuffled(spark, d), 0.3, sampling.CUBE).select("event_id", "_rank")


@query(f"WITH {PARTICLES}, c AS (SELECT _rank, count(*) AS n_rows, min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z FROM particles GROUP BY _rank) SELECT *, (coalesce(sum(n_rows) OVER (ORDER BY _rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS rank_offset FROM c")
def stored_counts(spark, d):
    return ranked.counts(spark, stored_octree(spark, d)).drop("min_y", "max_y")


def _damage(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.when(F.pmod("id", F.lit(997)) == 5, F.col("x") + 0.5).otherwise(F.col("x")))


def stored_copy(spark: SparkSession, d: str) -> str:
    """The stored octree with some values changed in place."""
    return stored(spark, d, "copy", "_table", lambda path: ranked.write(Dataset(_damage(leaves(spark, d))), path, leaf_key="id", block_rows=SMALL_BLOCK, file_rows=FILE_ROWS))


@query(STORED + """, hit AS (SELECT _rank, k // 256 AS b, max(n) AS n FROM stored GROUP BY _rank, k // 256 HAVING bool_or(id % 997 = 5))
SELECT _rank, (b * 256)::bigint AS first_row, (least(b * 256 + 256, n) - 1)::bigint AS last_row FROM hit""")
def verify_blocks(spark, d):
    return ranked.differing_blocks(spark, stored_octree(spark, d), stored_copy(spark, d))


@query(f"WITH {LEAVES} SELECT id, x, _rank, _leaf_id FROM leaves WHERE id % 997 = 5")
def verify_block_rows(spark, d):
    return ranked.differing_rows(spark, stored_octree(spark, d), stored_copy(spark, d)).select("id", "x", "_rank", "_leaf_id")


@query(f"WITH {_CHANGED}, x AS (SELECT id, count(*) AS n, sum(x) AS v FROM a GROUP BY id), y AS (SELECT id, count(*) AS n, sum(x) AS v FROM b GROUP BY id) SELECT id, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b FROM x FULL JOIN y USING (id) WHERE x.v IS DISTINCT FROM y.v")
def stored_compare(spark, d):
    a, b = _changed(spark, d)
    names, buckets = [], bucketed.buckets_for(a, b)
    for part, df in (("first", a), ("second", b)):
        path = stored(spark, d, f"bucketed-{part}", "_SUCCESS", lambda path: None)
        names.append(f"stored_{part}_{path[-16:]}")
        if not (spark.catalog.tableExists(names[-1]) and exists(spark, f"{path}/_SUCCESS")):
            bucketed.write(df, names[-1], path, "id", buckets)
    return bucketed.differing_keys(spark, *names, "id")


#: Byte by byte over each rank's values in stored order.
_BYTES = "flatten(list_transform(v, lambda x: list_transform(range({n}), lambda i: ((x >> (8 * i)::bigint) & 255)::ubigint)))"
CRC_SQL = STORED + f""", {_CRC_TABLE},
vals AS (SELECT _rank::bigint AS _rank, list(id ORDER BY k) AS ids, list(_leaf_id::bigint ORDER BY k) AS leaf_ids, count(*) AS n FROM stored GROUP BY _rank)
SELECT _rank, 'id' AS name, n AS n_rows, n * 8 AS n_bytes, printf('%016x', {_CRC_OF}) AS crc FROM (SELECT _rank, n, {_BYTES.format(n=8)} AS b FROM (SELECT _rank, n, ids AS v FROM vals)), tbl
UNION ALL SELECT _rank, '_leaf_id' AS name, n AS n_rows, n * 4 AS n_bytes, printf('%016x', {_CRC_OF}) AS crc FROM (SELECT _rank, n, {_BYTES.format(n=4)} AS b FROM (SELECT _rank, n, leaf_ids AS v FROM vals)), tbl"""


@query(CRC_SQL)
def column_crc(spark, d):
    rows = ranked.read(spark, stored_octree(spark, d)).df
    found = [crc.column_crc(rows, c).select("_rank", F.lit(c).alias("name"), "n_rows", "n_bytes", F.lower(F.lpad(F.conv(F.col("crc").cast("string"), 10, 16), 16, "0")).alias("crc")) for c in ("id", "_leaf_id")]
    return found[0].unionByName(found[1])


def grown_octree(spark: SparkSession, d: str) -> str:
    """The octree of all particles, stored in three runs, of which the cells with three are merged."""

    def make(path: str) -> None:
        rows = leaves(spark, d)
        growing.create(Dataset(rows.where("id % 3 = 0")), path, "id", shift=3)
        growing.append(spark, path, rows.where("id % 3 = 1"))
        growing.append(spark, path, rows.where("id % 3 = 2 AND _rank < 6"))
        growing.compact(spark, path, most_runs=2)
        growing.append(spark, path, rows.where("id % 3 = 2 AND _rank >= 6"))

    return stored(spark, d, "grown", f"_versions/{4:010d}", make)


@query(STORED + " SELECT _rank, _leaf_id, min(k)::bigint AS row_offset, count(*) AS n_rows, min(x) AS min_x, max(x) AS max_x FROM stored GROUP BY _rank, _leaf_id")
def stored_append_leaves(spark, d):
    return growing.leaves(spark, grown_octree(spark, d)).select("_rank", "_leaf_id", "row_offset", "n_rows", "min_x", "max_x")


@query(STORED + " SELECT id, _rank, k::bigint AS _row_in_rank FROM stored")
def stored_append_positions(spark, d):
    return growing.positioned(spark, grown_octree(spark, d)).select("id", "_rank", "_row_in_rank")


@query(f"WITH {PARTICLES} SELECT id, x, y, z FROM particles WHERE x BETWEEN 64 AND 128 AND y BETWEEN 0 AND 63.5 AND z BETWEEN 190 AND 256")
def stored_append_region(spark, d):
    return growing.region(spark, grown_octree(spark, d), REGION).select("id", "x", "y", "z")


# steps

_STEPPED = f"""{PARTICLES}, stepped AS (SELECT id, s AS _step, x + CASE WHEN (id + s) % 5 = 0 THEN s ELSE 0 END AS x FROM particles, (SELECT unnest(range(4)) AS s) WHERE (id * 31 + s * 7) % 10 < 7)"""


@query(f"""WITH {_STEPPED}, w AS (SELECT *, lag(_step) OVER o AS b, lag(x) OVER o AS was, lead(_step) OVER o AS n FROM stepped WINDOW o AS (PARTITION BY id ORDER BY _step))
SELECT id, _step, CASE WHEN b IS NULL OR b <> _step - 1 THEN 'appeared' ELSE 'moved' END AS change FROM w WHERE b IS NULL OR b <> _step - 1 OR was <> x
UNION ALL SELECT id, _step + 1 AS _step, 'vanished' AS change FROM w WHERE _step < 3 AND (n IS NULL OR n <> _step + 1)""")
def step_changes(spark, d):
    steps = particles(spark, d).select("id", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("_step"))
    steps = steps.where(F.pmod(F.col("id") * 31 + F.col("_step") * 7, F.lit(10)) < 7)
    moved = F.when(F.pmod(F.col("id") + F.col("_step"), F.lit(5)) == 0, F.col("_step")).otherwise(0)
    return changes.changes(steps.withColumn("x", F.col("x") + moved), values=("x",))


# boxes


def halo_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A box for every customer: most are small, one in a hundred is large, some reach beyond the grid."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("box_id"))
    k = F.col("box_id")
    width = F.when(k % 100 == 0, 90.0).otherwise((k % 30 + 2).cast("double"))
    for a, factor in (("x", 7919), ("y", 104729), ("z", 31337)):
        c = c.withColumn(f"{a}0", (k * factor % 1024).cast("double") / 4.0)
        c = c.withColumn(f"{a}1", F.col(f"{a}0") + width)
    return c


BOXES = """boxes AS (SELECT *, x0 + w AS x1, y0 + w AS y1, z0 + w AS z1 FROM (
  SELECT c_custkey AS box_id, (c_custkey * 7919 % 1024)::double / 4.0::double AS x0, (c_custkey * 104729 % 1024)::double / 4.0::double AS y0, (c_custkey * 31337 % 1024)::double / 4.0::double AS z0,
         CASE WHEN c_custkey % 100 = 0 THEN 90.0::double ELSE (c_custkey % 30 + 2)::double END AS w FROM customer))"""


@query(f"WITH {PARTICLES}, {BOXES} SELECT box_id, id FROM particles JOIN boxes ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1")
def box_join(spark, d):
    return boxes.box_join(particles(spark, d).select("id", "x", "y", "z"), halo_boxes(spark, d), axes()).select("box_id", "id")


@query(f"WITH {PARTICLES}, {BOXES} SELECT box_id, count(*) AS n_rows, min(id) AS least FROM particles JOIN boxes ON "
       + " AND ".join(f"({a} BETWEEN {a}0 AND {a}1 OR {a} BETWEEN {a}0 - 256 AND {a}1 - 256)" for a in "xyz") + " GROUP BY box_id")
def box_join_periodic(spark, d):
    aggregates = [F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("least")]
    return boxes.box_aggregates(particles(spark, d).select("id", "x", "y", "z"), halo_boxes(spark, d), axes(), aggregates, periodic=True).select("box_id", "n_rows", "least")


#: Four levels below the root, and at most 100 rows in a leaf above the last.
_BITS = " + ".join(f"(({a} >> {b}) & 1) * {1 << (3 * b + s)}" for b in range(4) for a, s in (("cx", 2), ("cy", 1), ("cz", 0)))
ADAPTIVE = f"""WITH {PARTICLES}, fine AS (SELECT id, ({_BITS})::bigint AS code FROM (SELECT id, least(floor(x / 16), 15)::bigint AS cx, least(floor(y / 16), 15)::bigint AS cy, least(floor(z / 16), 15)::bigint AS cz FROM particles)),
spot AS (SELECT id, l::int AS _level, code >> (3 * (4 - l)) AS _code FROM fine, (SELECT unnest(range(5)) AS l)), nodes AS (SELECT _level, _code, count(*) AS n_rows FROM spot GROUP BY ALL),
adaptive AS (SELECT c.*, c._code << (3 * (4 - c._level)) AS _first FROM nodes c LEFT JOIN nodes p ON p._level = c._level - 1 AND p._code = c._code >> 3 WHERE (c.n_rows <= 100 OR c._level = 4) AND (c._level = 0 OR p.n_rows > 100))
"""


@query(ADAPTIVE + "SELECT _level, _code, _first, ((_code + 1) << (3 * (4 - _level))) - 1 AS _last, n_rows, 256.0::double / (1 << _level) AS width FROM adaptive")
def adaptive_leaf_table(spark, d):
    found = adaptive.adaptive_leaves(particles(spark, d), axes(), 100, depth=4)
    return found.select("_level", "_code", "_first", "_last", "n_rows", (F.col("max_x") - F.col("min_x")).alias("width"))


@query(ADAPTIVE + "SELECT id, _first, _level FROM spot JOIN adaptive USING (_level, _code)")
def adaptive_leaf_assign(spark, d):
    p = particles(spark, d).select("id", "x", "y", "z")
    return adaptive.assign(p, axes(), adaptive.adaptive_leaves(p, axes(), 100, depth=4), depth=4).select("id", "_first", "_level")


# what stands beside stored rows, other layouts and exports, read back


@query(STORED + """ SELECT 'table' AS section, 'n_rows' AS name, count(*)::varchar AS value FROM stored
UNION ALL SELECT 'table', 'n_ranks', count(DISTINCT _rank)::varchar FROM stored UNION ALL SELECT 'table', 'n_blocks', count(DISTINCT (_rank, k // 256))::varchar FROM stored
UNION ALL SELECT 'table', v[1], v[2] FROM (SELECT unnest([['block_rows', '256'], ['order', '_leaf_id,id'], ['origin_x', '0.0'], ['origin_y', '0.0'], ['origin_z', '0.0'], ['scale_x', '256.0'], ['scale_y', '256.0'], ['scale_z', '256.0']]) AS v)
UNION ALL SELECT 'role', v[1], v[2] FROM (SELECT unnest([['x', 'x'], ['y', 'y'], ['z', 'z']]) AS v)
UNION ALL SELECT 'column', v[1], v[2] FROM (SELECT unnest([['id', 'i64'], ['x', 'f64'], ['y', 'f64'], ['z', 'f64'], ['_cx', 'i32'], ['_cy', 'i32'], ['_cz', 'i32'], ['_leaf', 'i32'], ['_leaf_id', 'i32'], ['_rank', 'i32']]) AS v)
UNION ALL SELECT 'rank', _rank::varchar, count(*)::varchar FROM stored GROUP BY _rank UNION ALL SELECT 'leaf', _leaf_id::varchar, count(*)::varchar FROM stored GROUP BY _leaf_id""")
def stored_header(spark, d):
    return ranked.header(spark, stored_octree(spark, d))


@query(f"WITH {PARTICLES} SELECT count(*) AS n_rows, (count(*) FILTER (x >= 0 AND x <= 256 AND y >= 0 AND y <= 256 AND z >= 0 AND z <= 256)) AS n_inside, 0.0::double AS origin_x, 256.0::double AS scale_x FROM particles")
def physical_box(spark, d):
    data = ranked.read(spark, stored_octree(spark, d))
    inside = in_box([data.axis(a) for a in AXES], list(data.origin), [o + s for o, s in zip(data.origin, data.scale, strict=True)], closed=True)
    return data.df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(inside).alias("n_inside"), F.lit(data.origin[0]).alias("origin_x"), F.lit(data.scale[0]).alias("scale_x"))


@query(f"WITH {EVENTS} SELECT event_id, (event_id % 3)::int AS _step, _rank FROM ranked")
def series_rows(spark, d):
    def make(path: str) -> None:
        for step in range(3):
            events(spark, d).df.where(F.pmod("event_id", F.lit(3)) == step).write.parquet(f"{path}/{step}")

    path = stored(spark, d, "series", "2/_SUCCESS", make)
    return ranked.series(spark, f"{path}/*", r"/(\d+)/[^/]*$").select("event_id", "_step", "_rank")


@query(STORED + " SELECT id, x, k::bigint AS _row_in_rank FROM stored WHERE _rank = 5")
def stored_other_codec(spark, d):
    path = stored(spark, d, "codec", "_table", lambda path: ranked.write(Dataset(leaves(spark, d)), path, compression="gzip", leaf_key="id"))
    return ranked.read(spark, path).df.where("_rank = 5").select("id", "x", "_row_in_rank")


@query(f"""WITH {PARTICLES}, s AS (SELECT id, _rank AS _source_rank, CASE WHEN _rank < 2 THEN 0 WHEN _rank < 5 THEN 1 ELSE 2 END AS _rank FROM particles)
SELECT id, _rank, (row_number() OVER (PARTITION BY _rank ORDER BY _source_rank, id) - 1)::bigint AS _row_in_rank FROM s""")
def stored_reshard(spark, d):
    path = stored(spark, d, "reshard", "_table", lambda path: ranked.write(redistribute.reranked(Dataset(particles(spark, d)), 8, 3), path, block_rows=SMALL_BLOCK, file_rows=FILE_ROWS))
    return ranked.read(spark, path).df.select("id", "_rank", "_row_in_rank")


@query("SELECT l_linenumber::bigint AS l_linenumber, l_quantity::double AS l_quantity, l_returnflag FROM lineitem")
def widened_columns(spark, d):
    return typed.widened(table(spark, d, "lineitem").select("l_linenumber", F.col("l_quantity").cast("float").alias("l_quantity"), "l_returnflag"))


@query(f"WITH {PARTICLES} SELECT id, x::float AS x, z::float AS z, _rank, (row_number() OVER (PARTITION BY _rank ORDER BY id) - 1)::bigint AS place FROM particles")
def row_major_records(spark, d):
    def make(path: str) -> None:
        zero = F.lit(0).cast("float")
        export.write_row_major(particles(spark, d).withColumns({c: zero for c in ("vx", "vy", "vz", "phi")}), path, block_rows=SMALL_BLOCK)

    back = export.read_row_major(spark, stored(spark, d, "records", "_SUCCESS", make))
    return back.select("id", "x", "z", "_rank", (F.col("_block") * SMALL_BLOCK + F.col("_in_block")).alias("place"))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def csv_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = stored(spark, d, "csv", "_SUCCESS", lambda path: export.write_csv(rows, path))
    return spark.read.schema(rows.schema).option("header", "true").csv(path)


@query(f"WITH {PARTICLES} SELECT id, x FROM particles WHERE _rank = 4 AND x >= 150.5 AND y BETWEEN 5 AND 100")
def selection_chain(spark, d):
    chosen = Selection().add("z", IS, 1).reset().add("_rank", IS, "4").add("_rank", IS, "4").add("x", AT_LEAST, 150.5).add("no such column", IS, 3).add("y", BETWEEN, 5, 100)
    return load(particles(spark, d), ["id"], ["x"], chosen)


@query(LEAF_TABLE + "SELECT _leaf_id, printf('%d : %.1f - %.1f, %.1f - %.1f, %.1f - %.1f : %d rows from %d, rank %d', _leaf_id, min_x, max_x, min_y, max_y, min_z, max_z, n_rows, row_offset, _rank) AS line FROM leaf_table")
def leaf_lines(spark, d):
    return octree.leaf_text(octree.leaf_table(leaves(spark, d), 2))


# order


@query(f"WITH {EXTENDED} SELECT event_id, _rank, _rowid FROM percents ORDER BY _rank, _rowid")
def order_by_rank_rowid(spark, d):
    return events(spark, d).extended().select("event_id", "_rank", "_rowid").orderBy("_rank", "_rowid")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def topk(spark, d):
    return table(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


# the SQL surface over views


def _views(spark: SparkSession, d: str) -> None:
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        table(spark, d, name).createOrReplaceTempView(name)


#: One text for both engines.
SHARED_SQL = {
    "sql_join_inner": "SELECT n_name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_left_join": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey",
    "sql_cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "sql_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "sql_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "sql_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "sql_group_having": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "sql_distinct_count": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY o_orderstatus",
    "sql_aggregates": "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, min(l_extendedprice) AS least, max(l_extendedprice) AS most, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_window_rank": "SELECT o_orderkey, o_custkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders",
    "sql_running_sum": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM events",
    "sql_lag": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "sql_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey AS k FROM supplier",
    "sql_except": "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0",
    "sql_cte_subquery": "WITH m AS (SELECT avg(o_totalprice) AS a FROM orders) SELECT o_orderkey, o_totalprice FROM orders, m WHERE o_totalprice > 1.5 * a",
    "sql_scalar_subquery": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)",
    "sql_self_join": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_case_like": "SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' WHEN p_size BETWEEN 1 AND 10 THEN 'small' ELSE 'other' END AS kind FROM part WHERE p_name IS NOT NULL",
    "sql_order_limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
}


def _shared(name: str, text: str):
    def run(spark, d):
        _views(spark, d)
        return spark.sql(text)

    run.__name__ = name
    return run


for _name, _text in SHARED_SQL.items():
    QUERIES[_name] = _shared(_name, _text)
    SQL[_name] = _text
