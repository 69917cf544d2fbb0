"""Exact search of the largest integer inner products by a table of distances to pivots.

A component x becomes floor(64 * x).  With d the distance of query q and candidate c,
``2 q.c = |q|**2 + |c|**2 - d**2``, and for every pivot p ``d >= |d(q, p) - d(c, p)|``: the
distances of all candidates to many pivots, computed once, give the largest of these lower
bounds and so an upper bound of the inner product.  Candidates are evaluated in order of
their bounds; the search ends when the next bound is below the k-th best product, and an
equal one goes on, as a tie may have the smaller id.  Products are exact: 32-bit or 64-bit
floats are used only where the lengths of the vectors prove that every partial sum is a
whole number they hold, otherwise 64-bit integers.

Vectors are dealt to blocks by a hash of their id and moved once, as compact records.  A
block gets its table of pivot distances and searches its own queries; the k-th best product
found there goes with a query as its floor.  The blocks then stay where they are, and all
queries stream past them in chunks: a stated query set against all rows, in blocks.  A
candidate whose bound is below the floor is not looked at.  The number of rows of a block
follows the input and the cores between two limits; no result depends on it.

Defined cases: vectors that are null, or hold null, non-finite or larger components than
2**25 / sqrt(dimension) (products would not fit 64 bits), and rows of a null id, take no
part; only vectors of a query's dimension are its candidates; rows that share id and
dimension count once, with their smallest vector, and an id's vectors of several dimensions
are queries of their own; a query's own id is no candidate; ties go to the smaller id; with
fewer candidates than k all are returned; zero and empty vectors take part, with products
of zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolake.llm import packing
from astrolake.llm.vectors import bounded, by_dimension

SCALE, PIVOTS = 64, 32
#: Rows of a block, between these, and queries of a chunk.
LEAST_BLOCK, MOST_BLOCK, CHUNK = 4096, 1 << 17, 64
#: Candidates evaluated first, and how many times as many each later step takes.
STEP, GROWTH = 128, 4
#: Share of a distance that rounding may cost; the table holds 32-bit floats.
SLACK = 1e-5
NONE = np.iinfo(np.int64).min


def exact_kind(longest: float) -> np.dtype:
    """A type whose arithmetic is exact for products of vectors of at most this squared length (partial sums stay below it)."""
    return np.dtype(np.float32) if longest < 1 << 23 else np.dtype(np.float64) if longest < 1 << 52 else np.dtype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` to one vector."""
    gap = a.astype(np.float64) - b.astype(np.float64)
    return np.sqrt((gap * gap).sum(axis=1))


def pivot_table(vectors: np.ndarray, pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Rows chosen as pivots, each the farthest from those before it, and the distances of all rows to each."""
    chosen, table = [], []
    nearest, at = np.full(len(vectors), np.inf), int(np.argmax((vectors.astype(np.float64) ** 2).sum(axis=1))) if len(vectors) else 0
    for _ in range(min(pivots, len(vectors))):
        d = distances(vectors, vectors[at])
        chosen.append(at)
        table.append(d.astype(np.float32))
        nearest = np.minimum(nearest, d)
        at = int(np.argmax(nearest))
        if nearest[at] == 0:
            break
    return np.array(chosen, np.int64), np.array(table, np.float32).reshape(len(chosen), len(vectors))


class Block:
    """Vectors of one dimension in order of their ids, with their table of pivot distances."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, table: np.ndarray):
        self.ids, self.pivots, self.table = ids, vectors[pivots].astype(np.float64), table
        lengths = vectors.astype(np.float64)
        self.squares = (lengths * lengths).sum(axis=1)
        self.vectors, self.longest = vectors, self.squares.max(initial=0.0)
        #: What a bound is without the distance, with room for rounding.
        self.ceiling = self.squares / 2 + SLACK * (1 + self.squares)
        self.as_kind = {vectors.dtype: vectors}
        self.evaluated = self.asked = 0

    def of_kind(self, kind: np.dtype) -> np.ndarray:
        if kind not in self.as_kind:
            self.as_kind[kind] = self.vectors.astype(kind)
        return self.as_kind[kind]

    def bounds(self, query: np.ndarray, square: float) -> np.ndarray:
        """Upper bounds of the products of the query with all rows."""
        gap = self.pivots - query.astype(np.float64)
        to_pivots = np.sqrt((gap * gap).sum(axis=1))
        least, gap = np.zeros(len(self.ids), np.float32), np.empty(len(self.ids), np.float32)
        for row, d in zip(self.table, to_pivots.astype(np.float32), strict=True):
            np.abs(np.subtract(row, d, out=gap), out=gap)
            np.maximum(least, gap, out=least)
        room = SLACK * 2 * (np.sqrt(square) + np.sqrt(self.longest))
        least = np.maximum(least.astype(np.float64) - room, 0)
        return self.ceiling + (square / 2 + SLACK * square) - least * least / 2

    def best(self, query_id: int, query: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, products) of the k best, ties to the smaller id, of those with at least ``floor``."""
        square = float((query.astype(np.float64) ** 2).sum())
        kind = exact_kind(max(square, self.longest))
        vectors, q = self.of_kind(kind), query.astype(kind)
        bound = self.bounds(query, square)
        own = np.searchsorted(self.ids, query_id)
        if own < len(self.ids) and self.ids[own] == query_id:
            bound[own] = -np.inf
        todo = np.flatnonzero(bound >= (-1e300 if floor == NONE else floor))
        rows, score, kth, step = np.zeros(0, np.int64), np.zeros(0, np.int64), floor, STEP
        self.asked += len(self.ids)
        while len(todo):
            n = min(step, len(todo))
            if n < len(todo):  # the largest bounds come last
                todo = todo[np.argpartition(bound[todo], len(todo) - n)]
            todo, now = todo[: len(todo) - n], todo[len(todo) - n :]
            self.evaluated += n
            made = (vectors[now] @ q).astype(np.int64)
            if kth != NONE:
                now, made = now[made >= kth], made[made >= kth]
            rows, score = np.concatenate((rows, now)), np.concatenate((score, made))
            if len(score) >= k:
                kth = max(kth, int(np.partition(score, len(score) - k)[len(score) - k]))
                rows, score = rows[score >= kth], score[score >= kth]
                todo = todo[bound[todo] >= kth]
            step *= GROWTH
        top = np.lexsort((self.ids[rows], -score))[:k]
        return rows[top], score[top]


def small(a: np.ndarray) -> np.ndarray:
    """The integers in the least type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        if not len(a) or (a.min() >= np.iinfo(kind).min and a.max() <= np.iinfo(kind).max):
            return a.astype(kind)
    return a


def once(ids: np.ndarray, asked: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per id, in order: the smallest vector."""
    order = np.lexsort((*vectors.T[::-1], ids)) if vectors.shape[1] else np.argsort(ids, kind="stable")
    order = order[packing.groups(ids[order])[0]]
    return ids[order], asked[order], vectors[order]


def records(rows: DataFrame) -> DataFrame:
    """(block, dim, blob of ids, whether they are queries, and integer vectors): a few for each task and block."""

    def run(batches):
        for batch in batches:
            ids, block, asked = batch.column("id").to_numpy(), batch.column("block").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for dim, at, matrix in by_dimension(batch.column("v")):
                vectors = np.floor(matrix * SCALE).astype(np.int64)
                order = np.argsort(block[at], kind="stable")
                for b, s in packing.by_bucket(block[at][order]):
                    i, a, v = once(ids[at][order[s]], asked[at][order[s]], vectors[order[s]])
                    out.append((b, dim, packing.pack(i, a.astype(np.uint8), small(v.ravel()))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["block", "dim", "blob"])

    return rows.mapInArrow(run, "block long, dim long, blob binary")


def assembled(sent: DataFrame, k: int, pivots: int, chunk: int) -> DataFrame:
    """Of every block (block, dim, chunk, blob): chunk -1 is the block with its table, the others its queries with their floors."""

    def run(table: pa.Table) -> pa.Table:
        b, dim = table.column("block")[0].as_py(), table.column("dim")[0].as_py()
        got = [packing.unpack(x) for x in table.column("blob").to_pylist()]
        ids, asked = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        ids, asked, vectors = once(ids, asked, np.concatenate([g[2].astype(np.int64) for g in got]).reshape(len(ids), dim))
        chosen, distance = pivot_table(vectors, pivots)
        block = Block(ids, vectors, chosen, distance)
        out = [(-1, packing.pack(ids, small(vectors.ravel()), chosen, distance.ravel()))]
        mine = np.flatnonzero(asked)
        floors = np.full(len(mine), NONE)
        for i, row in enumerate(mine.tolist()):
            _, score = block.best(int(ids[row]), vectors[row], k, NONE)
            if len(score) == k:
                floors[i] = score[-1]
        for a in range(0, len(mine), chunk):
            s = mine[a : a + chunk]
            out.append((a // chunk, packing.pack(ids[s], small(vectors[s].ravel()), floors[a : a + chunk])))
        n = len(out)
        return packing.released(pa.table({"block": pa.array([b] * n, pa.int64()), "dim": pa.array([dim] * n, pa.int64()), "chunk": pa.array([x[0] for x in out], pa.int64()), "blob": pa.array([x[1] for x in out], pa.binary())}))

    return sent.groupBy("block", "dim").applyInArrow(run, "block long, dim long, chunk long, blob binary")


def met(placed: DataFrame, k: int) -> DataFrame:
    """(query_id, dim, vec_id, score) of every query in every block, from rows in order of block, dimension, and the block before its queries."""

    def run(batches):
        block, of = None, None
        for batch in batches:
            for b, dim, chunk, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "dim", "chunk", "blob")), strict=True):
                got = packing.unpack(blob)
                if chunk < 0:
                    ids, flat, chosen, distance = got
                    block, of = Block(ids, flat.astype(np.int64).reshape(len(ids), dim), chosen, distance.reshape(len(chosen), len(ids))), (b, dim)
                    continue
                if of != (b, dim):
                    continue  # no vector of this dimension in the block
                ids, flat, floors = got
                found = [block.best(q, v, k, f) for q, v, f in zip(ids.tolist(), flat.astype(np.int64).reshape(len(ids), dim), floors.tolist(), strict=True)]
                n = [len(r) for r, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(np.full(sum(n), dim), pa.int64()), pa.array(np.concatenate([block.ids[r] for r, _ in found]), pa.int64()), pa.array(np.concatenate([s for _, s in found]), pa.int64())], names=["query_id", "dim", "vec_id", "score"])

    return placed.mapInArrow(run, "query_id long, dim long, vec_id long, score long")


def largest_products(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(query_id, dim, rank, vec_id, score): the k largest products of every row that ``is_query`` (a condition on ``id``) holds for."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(bounded(F.col("v"), F.lit(2.0**25) / F.sqrt(F.size("v").cast("double"))))
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // (block or min(MOST_BLOCK, max(LEAST_BLOCK, n // (4 * cores))))))
    sent = records(rows.select("id", "v", F.coalesce(is_query, F.lit(False)).alias("asked"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")))
    made = packing.written(assembled(sent.repartition(blocks, "block"), k, pivots, chunk), "pivot-blocks")
    queries = made.where("chunk >= 0").withColumn("chunk", F.struct("block", "chunk")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    held = made.where("chunk < 0").withColumn("chunk", F.struct(F.lit(-1).cast("long").alias("block"), "chunk"))
    placed = held.unionByName(queries).repartition(blocks, "block").sortWithinPartitions("block", "dim", "chunk")
    found = met(placed.withColumn("chunk", F.col("chunk.chunk")), k)
    best = Window.partitionBy("query_id", "dim").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "dim", "rank", "vec_id", "score")
