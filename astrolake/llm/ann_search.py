"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are scaled to length one, so nearness by cosine is nearness by distance, and
projected onto ``M`` Gaussian directions.  The projected distance squared over the true
distance squared follows a chi-square law with M degrees of freedom.  The projected
points of a block stand in a kd-tree; a query takes its leaves in order of their least
projected distance, and verifies points of them by their exact cosine while the stopping
test allows: a point as near as the k-th best so far would, with probability
``CONFIDENCE``, stand within the chi-square quantile times the k-th best distance squared,
so points beyond that projected distance are passed over, and the search ends at the first
leaf that lies beyond it.

All vectors are indexed, in blocks of about ``BLOCK`` rows dealt by hash.  A block is moved
once and builds its tree once; all queries stream past it in chunks of about ``CHUNK``: a
stated query set against all rows, in blocks.  A block's best few go on, and the best of all
blocks are chosen per query.  Vectors are scaled by powers of two first, which is exact, so
that squares of very large or small components stay numbers.

Defined cases: vectors that are null, empty, of zero length, or hold null or non-finite
components take no part; only vectors of the query's dimension are candidates; a query's
own id is no candidate; ties go to the smaller id; a repeated id counts once per distinct
vector, as query and as candidate; with fewer candidates than k all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from astrolake.llm import packing

M, CONFIDENCE, LEAF = 8, 0.95, 64
#: Leaves looked at before the stopping test is made again.
STEP = 4
BLOCK, CHUNK = 16384, 64
#: More than rounding puts between the scores of equal vectors.
SLACK = 1e-12
SEED = 5


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi2_m <= x) = p, for even m."""

    def below(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def directions(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(SEED + dim).normal(size=(dim, m))


class KdTree:
    """Leaves of a kd-tree over projected points: an order of the points, leaf bounds, leaf boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order, bounds, todo = np.arange(len(points)), [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            part = points[self.order[a:b]]
            if b - a <= leaf:
                bounds.append((a, b))
                continue
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.bounds = sorted(bounds)
        self.low = np.array([points[self.order[a:b]].min(axis=0) for a, b in self.bounds])
        self.high = np.array([points[self.order[a:b]].max(axis=0) for a, b in self.bounds])

    def least_squares(self, q: np.ndarray) -> np.ndarray:
        """Least squared distance of each query to each leaf's box."""
        gap = np.maximum(np.maximum(self.low[None] - q[:, None], q[:, None] - self.high[None]), 0)
        return (gap * gap).sum(axis=2)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component near one; angles and their rounding stay."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1][:, None])


class Block:
    """Vectors with the kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = M, leaf: int = LEAF):
        self.ids, self.vectors, self.m = ids, scaled(vectors), m
        self.unit = self.vectors / np.sqrt((self.vectors * self.vectors).sum(axis=1))[:, None]
        self.points = self.unit @ directions(vectors.shape[1], m)
        self.tree = KdTree(self.points, leaf)


def search(block: Block, query_ids, queries, k: int, confidence: float = CONFIDENCE, tally: list | None = None):
    """Per query the k best of the block as arrays (query number, candidate number, cosine); ``tally`` receives the share of points verified."""
    ids, vectors, unit, points, tree = block.ids, block.vectors, block.unit, block.points, block.tree
    queries = scaled(queries)
    uq = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
    pq, cut = uq @ directions(queries.shape[1], block.m), chi_square_quantile(confidence, block.m)
    found_q, found_c, found_s = [], [], []
    for q in range(len(queries)):
        least = tree.least_squares(pq[q : q + 1])[0]
        order = np.argsort(least, kind="stable")
        best_s, best_c, kth, i = np.zeros(0), np.zeros(0, np.int64), -np.inf, 0
        best_p, verified = np.zeros(0), np.zeros(len(ids), bool)

        def verify(rows, q=q, verified=verified):
            """Exact cosines of the rows; the best so far, with all that are as near as the k-th."""
            nonlocal best_s, best_c, best_p, kth
            verified[rows] = True
            s, c, p = np.r_[best_s, unit[rows] @ uq[q]], np.r_[best_c, rows], np.r_[best_p, ((points[rows] - pq[q]) ** 2).sum(axis=1)]
            if len(s) >= k:
                kth = np.partition(s, len(s) - k)[len(s) - k]
            keep = s >= kth - SLACK
            best_s, best_c, best_p = s[keep], c[keep], p[keep]

        def within(leaves, far, q=q, verified=verified):
            """Rows of the leaves whose projected distance is at most ``far``."""
            rows = np.concatenate([tree.order[slice(*tree.bounds[j])] for j in leaves])
            rows = rows[(ids[rows] != query_ids[q]) & ~verified[rows]]
            return rows[((points[rows] - pq[q]) ** 2).sum(axis=1) <= far]

        while i < len(order):
            far = cut * (max(2 - 2 * kth, 0.0) + SLACK)
            if least[order[i]] > far:
                break
            verify(within(order[i : i + STEP], far))
            i += STEP
        # copies stand at one projected distance: none is left out because its leaf came later
        reach = best_p.max(initial=0.0) * (1 + 1e-9) + SLACK
        verify(within(order[: max(1, int(np.searchsorted(least[order], reach, "right")))], reach))
        if tally is not None:
            tally.append(verified.mean())
        # products of equal rows differ in their last places: the exact cosine decides among all that are as near
        a, b = queries[q : q + 1], vectors[best_c]
        s = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        top = np.lexsort((ids[best_c], -s))[:k]
        found_q.append(np.full(len(top), q))
        found_c.append(best_c[top])
        found_s.append(s[top])
    return np.concatenate(found_q), np.concatenate(found_c), np.concatenate(found_s)


def _blobs(rows: DataFrame, column: str) -> DataFrame:
    """(column, dim, blob of ids and vectors) per task, from (id, v, dim, column)."""

    def run(batches):
        for batch in batches:
            key, dim = batch.column(column).to_numpy(), batch.column("dim").to_numpy()
            ids, flat = batch.column("id").to_numpy(), batch.column("v")
            values, offsets = flat.flatten().to_numpy(), np.r_[0, np.cumsum(dim)]
            order = np.lexsort((dim, key))
            out = [[], [], []]
            starts, _ = packing.groups(key[order], dim[order]) if len(key) else ([], None)
            for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
                o = order[a:b]
                out[0].append(int(key[o[0]]))
                out[1].append(int(dim[o[0]]))
                out[2].append(packing.pack(ids[o], np.concatenate([values[offsets[i] : offsets[i + 1]] for i in o])))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=[column, "dim", "blob"])

    return rows.mapInArrow(run, f"{column} long, dim long, blob binary")


def neighbours(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, chunk: int = CHUNK, m: int = M, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``is_query`` (a condition on ``id``) holds for."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    rows = rows.dropDuplicates(["id", "v"]).withColumn("dim", F.size("v").cast("long"))
    rows = packing.written(rows.withColumn("h", F.xxhash64("id", "v")), "vectors")
    asked = rows.where(is_query)
    n, nq = rows.count(), asked.count()
    blocks, chunks = max(1, -(-n // block)), max(1, -(-nq // chunk))
    left = _blobs(rows.withColumn("block", F.pmod("h", F.lit(blocks))).select("id", "v", "dim", "block"), "block").withColumn("chunk", F.lit(-1).cast("long"))
    right = _blobs(asked.withColumn("chunk", F.pmod("h", F.lit(chunks))).select("id", "v", "dim", "chunk"), "chunk").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(batches):
        """Rows in order of block, dimension, and the block's vectors before the queries."""
        of, parts, held = None, [], None
        for batch in batches:
            for b, dim, number, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "dim", "chunk", "blob")), strict=True):
                got = packing.unpack(blob)
                got[1] = got[1].reshape(len(got[0]), dim)
                if of != (b, dim):
                    of, parts, held = (b, dim), [], None
                if number < 0:
                    parts.append(got)
                    continue
                if not parts and held is None:
                    continue  # no vector of this dimension in the block
                if held is None:
                    held, parts = Block(np.concatenate([g[0] for g in parts]), np.concatenate([g[1] for g in parts]), m), []
                i, c, s = search(held, *got, k, confidence)
                yield pa.RecordBatch.from_arrays([pa.array(got[0][i], pa.int64()), pa.array(held.ids[c], pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    placed = left.unionByName(right).repartition(blocks, "block").sortWithinPartitions("block", "dim", "chunk")
    found = placed.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
