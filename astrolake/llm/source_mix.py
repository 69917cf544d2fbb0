"""Mixing sources to target weights by Pareto order sampling.

Sources have weights; all sizes together are shared out by weight, but no source
gets more than ``most`` times its own size: the excess is shared again by weight
among the others (water filling, solved in closed form over the sorted ratios).

A source with target r times its size takes floor(r) whole copies of every
document.  The rest of the target is an unequal-probability sample: a document of
size s has inclusion odds  f/(1-f) * (s/mean)**TILT,  f being the fraction left, and
Pareto order sampling ranks documents by  u/(1-u) divided by these odds, u a random
number that is a hash of the document.  The sample is fixed in size: the first
documents of the ranking whose sizes reach the rest of the target, the last one only
where that comes nearer.

A source may hold a third of all rows, so it is never sorted in one piece: ranks are
monotone in a cell number, sizes are summed per source and cell, a running sum over
the cells (a bounded number per source) finds the one that holds the boundary, and only
the documents of that cell are put in order.

Defined cases: null source is a source, last in order; null or wordless texts have
size 0 and are taken 0 times; rows equal in id and size draw the
same number and are taken alike; reruns agree; other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolake.llm import packing

WEIGHTS = (5, 2, 1)
MOST = 3
TILT = 0.25
CELLS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source."""
    order = Window.orderBy(F.col("source").isNull(), F.hex(F.encode("source", "UTF-8")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # sources in order of cap by weight; the first whose level stays under its ratio ends the capped ones
    found = ranked.withColumn("level", level)
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return found.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull() | (F.col("weight") * F.col("final") > F.col("cap")), F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def uniform(key: Column) -> Column:
    """A number in (0, 1) fixed by the key: 52 bits of its md5."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (_source, _key, _size, ...) with the plan of their source and the rank ``_q`` (null for size 0)."""
    f = F.least(F.greatest(F.col("rest") / F.col("source_size"), F.lit(1e-9)), F.lit(1 - 1e-9))
    u = uniform(F.col("_key"))
    q = (u / (1 - u)) / (f / (1 - f) * F.pow(F.col("_size") / F.col("mean"), F.lit(TILT)))
    return rows.join(plan, rows["_source"].eqNullSafe(plan["source"])).withColumn("_q", F.when(F.col("_size") > 0, q))


def plan_of(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: target, whole copies, and the last rank that the sample takes.  ``rows``: _source, _key, _size."""
    sums = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.avg(F.when(F.col("_size") > 0, F.col("_size"))).alias("mean"))
    sums = sums.withColumnRenamed("_source", "source")
    goal = targets(sums.select("source", "source_size"), weights, most).withColumnRenamed("source", "_g").drop("source_size")
    plan = sums.join(goal, sums["source"].eqNullSafe(goal["_g"])).drop("_g")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    ranked = _ranked(rows, plan).where("_size > 0").withColumn("_cell", F.floor(F.col("_q") / (1 + F.col("_q")) * CELLS).cast("long"))
    cells = ranked.groupBy("_source", "_cell", "rest").agg(F.sum("_size").alias("_sum"))
    along = Window.partitionBy("_source").orderBy("_cell")
    edge = cells.withColumn("_upto", F.sum("_sum").over(along)).withColumn("_before", F.col("_upto") - F.col("_sum")).where((F.col("_upto") > F.col("rest")) & (F.col("_before") <= F.col("rest")))
    edge = edge.select(F.col("_source").alias("_es"), F.col("_cell").alias("_ec"), "_before")
    # the documents of the boundary cell, in order of rank
    inside = ranked.join(edge, ranked["_source"].eqNullSafe(edge["_es"]) & (ranked["_cell"] == edge["_ec"]))
    order = Window.partitionBy("_source").orderBy("_q", "_key", "_size").rowsBetween(Window.unboundedPreceding, 0)
    reach = inside.withColumn("_reach", F.col("_before") + F.sum("_size").over(order))
    fits = reach.where(F.col("_reach") - F.col("rest") <= F.col("rest") - (F.col("_reach") - F.col("_size")))
    last = fits.groupBy("_source").agg(F.max(F.struct("_q", "_key", "_size")).alias("last_in"))
    bounds = edge.join(last, edge["_es"].eqNullSafe(last["_source"]), "left").select("_es", F.col("_ec").alias("edge"), "last_in")
    return plan.join(bounds, plan["source"].eqNullSafe(bounds["_es"]), "left").drop("_es")


def _copies() -> Column:
    """Copies taken of a ranked row."""
    cell = F.floor(F.col("_q") / (1 + F.col("_q")) * CELLS).cast("long")
    extra = (
        F.when(F.col("edge").isNull(), F.col("rest") >= F.col("source_size"))
        .when(cell != F.col("edge"), cell < F.col("edge"))
        .otherwise(F.coalesce(F.struct("_q", "_key", "_size") <= F.col("last_in"), F.lit(False)))
    )
    return F.when(F.col("_size") > 0, F.col("whole") + extra.cast("long")).otherwise(F.lit(0)).cast("long")


def _slim(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> list[Column]:
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return [F.col(source).alias("_source"), size_of(F.col(text)).alias("_size"), key.alias("_key")]


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """One row per document: its id, size, source_size, target, copies and taken.

    Sizes are counted once and kept in the shared folder without the texts."""
    rows = packing.written(docs.select(F.col(doc_id), *_slim(docs, doc_id, text, source, seed)), "sizes")
    plan = plan_of(rows.drop(doc_id), weights, most)
    return _ranked(rows, plan).withColumn("copies", _copies()).select(doc_id, F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """The mixed corpus itself: every document as many times as it is taken."""
    slim = packing.written(docs.select(*_slim(docs, doc_id, text, source, seed)), "sizes")
    plan = packing.written(plan_of(slim, weights, most), "mix-plan")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *_slim(docs, doc_id, text, source, seed))
    taken = _ranked(rows, plan).withColumn("_copies", _copies()).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_doc.*")
