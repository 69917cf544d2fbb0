"""Vector codes: one small codebook per part of the vectors, refined by rounds of integer means.

A component x becomes the integer floor(4096 * x), and a vector is cut into ``PARTS``
consecutive parts.  The codebook of a part position starts as that part of the vectors of
the ``ENTRIES`` smallest ids.  In each round the codebooks, each in a kd-tree, are
broadcast; tasks assign every part to its nearest entry and send sums and counts of their
own parts; these are added by Spark, and an entry becomes the floor of the mean.  All of it
is integer arithmetic, so the result does not depend on how rows are dealt.

The search of the tree is branch and bound over boxes.  A node whose bound equals the best
distance so far is visited too, as it may hold an entry of a lower index that ties.

What the driver and every task hold is the codebooks: ``ENTRIES`` times the dimension
integers, whatever the number of vectors; tasks send that many sums each.  Rounds end early
once they change nothing, as later ones would not either.

Defined cases: vectors that are null, or hold null, non-finite or larger components than
2**18 / sqrt(dimension) (their distances would not fit 64 bits) take no part; vectors of
each dimension have their own codebooks; where the dimension is no multiple of the parts,
part i begins at component i * dimension // parts; fewer ids than entries make smaller
codebooks; an empty vector has zeros as code and error; of rows that share an id the
smallest vector is the first entry's, and all of them are coded; rows of a null id are
coded, but start no entry; repeated rows count as often as they stand there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.llm import packing
from astrolake.llm.vectors import bounded, by_dimension

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Entries of a leaf of the trees.
LEAF = 2
#: Groups whose sums are broadcast; more of them meet their rows by a shuffle.
BROADCAST_GROUPS = 1 << 16

#: Entries of each part position, by dimension.
Codebooks = dict[int, list[np.ndarray]]


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * SCALE).astype(np.int64)


def cuts(dim: int, parts: int) -> list[int]:
    return [i * dim // parts for i in range(parts + 1)]


class KdTree:
    """The entries of a codebook in boxes; a node is (low, high, entries) or (low, high, left, right)."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.root = entries, self._node(entries, np.arange(len(entries)), max(1, leaf))

    def _node(self, entries: np.ndarray, rows: np.ndarray, leaf: int):
        part = entries[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        if len(rows) <= leaf or entries.shape[1] == 0:
            return low, high, np.sort(rows)
        axis = int(np.argmax(high - low))
        rows, half = rows[np.argsort(part[:, axis], kind="stable")], len(rows) // 2
        return low, high, self._node(entries, rows[:half], leaf), self._node(entries, rows[half:], leaf)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties to the lower one) and squared distance of every point."""
        best, index = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(self.entries))
        self._visit(self.root, np.arange(len(points)), points, best, index)
        return index, best

    def _visit(self, node, rows, points, best, index) -> None:
        """All points that may have their nearest entry below the node, the nearer child first."""
        if not len(rows):
            return
        if len(node) == 3:
            for e in node[2].tolist():
                gap = points[rows] - self.entries[e]
                d = (gap * gap).sum(axis=1)
                better = (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
                best[rows[better]], index[rows[better]] = d[better], e
            return
        left, right = node[2], node[3]
        to_left, to_right = bound(left, points[rows]), bound(right, points[rows])
        first = to_left <= to_right
        self._visit(left, rows[first], points, best, index)
        self._visit(right, rows[~first], points, best, index)
        self._visit(right, rows[first & (to_right <= best[rows])], points, best, index)
        self._visit(left, rows[~first & (to_left <= best[rows])], points, best, index)


def bound(node, points: np.ndarray) -> np.ndarray:
    """Least squared distance of each point to the node's box."""
    gap = np.maximum(np.maximum(node[0] - points, points - node[1]), 0)
    return (gap * gap).sum(axis=1)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(doc, id, v) of the vectors that take part."""
    rows = packing.wrapped(vectors, id=vec_id, v=vector).withColumns({"id": F.col("id").cast("long"), "v": F.col("v").cast("array<double>")})
    return rows.where(F.col("v").isNotNull() & bounded(F.col("v"), F.lit(2.0**18) / F.sqrt(F.size("v").cast("double"))))


def first_entries(rows: DataFrame, entries: int) -> dict[int, np.ndarray]:
    """By dimension the integer vectors of the smallest ids, in order.  Tasks send that many ids at most."""

    def run(batches):
        held: dict[int, dict[int, tuple]] = {}
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for dim, at, matrix in by_dimension(batch.column("v")):
                mine = held.setdefault(dim, {})
                last = max(mine) if len(mine) == entries else None
                small = np.unique(ids[at])[:entries]
                for i in np.flatnonzero(ids[at] <= (small[-1] if last is None else min(last, small[-1]))).tolist():
                    v, key = tuple(integers(matrix[i]).tolist()), int(ids[at[i]])
                    mine[key] = min(mine.get(key, v), v)
                held[dim] = {key: mine[key] for key in sorted(mine)[:entries]}
        out = [(dim, key, list(v)) for dim, mine in held.items() for key, v in mine.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["dim", "id", "v"])

    from pyspark.sql import Window

    found = rows.where("id IS NOT NULL").select("id", "v").mapInArrow(run, "dim long, id long, v array<long>").groupBy("dim", "id").agg(F.min("v").alias("v"))
    found = found.withColumn("k", F.row_number().over(Window.partitionBy("dim").orderBy("id"))).where(F.col("k") <= entries)
    out: dict[int, list] = {}
    for row in found.orderBy("dim", "k").collect():
        out.setdefault(row["dim"], []).append(row["v"])
    return {dim: np.array(v, np.int64).reshape(len(v), dim) for dim, v in out.items()}


def assigned(trees: list[KdTree], vectors: np.ndarray, dim: int):
    """Per part: its number, from where to where it goes, the entries and the distances of all vectors."""
    at = cuts(dim, len(trees))
    for p, tree in enumerate(trees):
        yield p, at[p], at[p + 1], *tree.nearest(vectors[:, at[p] : at[p + 1]])


def next_round(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry becomes the floor of the mean of the parts assigned to it; entries of no parts stay."""
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        trees = {dim: [KdTree(b) for b in parts] for dim, parts in held.value.items()}
        sums = {dim: [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in parts] for dim, parts in held.value.items()}
        for batch in batches:
            for dim, _, matrix in by_dimension(batch.column("v")):
                if dim not in trees:
                    continue
                vectors = integers(matrix)
                for p, a, b, entry, _ in assigned(trees[dim], vectors, dim):
                    np.add.at(sums[dim][p][0], entry, vectors[:, a:b])
                    np.add.at(sums[dim][p][1], entry, 1)
        out = []
        for dim, parts in sums.items():
            for p, (total, count) in enumerate(parts):
                for e in np.flatnonzero(count).tolist():
                    out += [(dim, p, e, -1, int(count[e])), *((dim, p, e, i, x) for i, x in enumerate(total[e].tolist()))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], names=["dim", "part", "entry", "place", "total"])

    sent = rows.select("v").mapInArrow(run, "dim long, part long, entry long, place long, total long")
    total: dict[tuple, int] = {tuple(r[:4]): int(r["total"]) for r in sent.groupBy("dim", "part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    held.unpersist()
    out = {dim: [b.copy() for b in parts] for dim, parts in books.items()}
    for (dim, p, e, place), x in total.items():
        if place >= 0:
            out[dim][p][e, place] = x // total[dim, p, e, -1]
    return out


def train(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks of all usable vectors."""
    rows = usable(vectors, vec_id, vector)
    books: Codebooks = {}
    for dim, first in first_entries(rows, entries).items():
        at = cuts(dim, parts)
        books[dim] = [first[:, a:b].copy() for a, b in zip(at[:-1], at[1:], strict=True)]
    for _ in range(rounds):
        after = next_round(rows, books)
        if all(np.array_equal(x, y) for dim in books for x, y in zip(books[dim], after[dim], strict=True)):
            break
        books = after
    return books


def digest(parts: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and place, as decimals between commas."""
    return hashlib.sha256(",".join(str(x) for b in parts for x in b.ravel().tolist()).encode()).hexdigest()


def encoded(vectors: DataFrame, books: Codebooks, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``doc`` (the row), code (array of entries by part), error (squared distances summed over parts) and codebooks_sha256 (of its dimension)."""
    rows = usable(vectors, vec_id, vector)
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        trees = {dim: [KdTree(b) for b in parts] for dim, parts in held.value.items()}
        names = {dim: digest(parts) for dim, parts in held.value.items()}
        for batch in batches:
            code, error = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            name = [None] * batch.num_rows
            for dim, at, matrix in by_dimension(batch.column("v")):
                if dim not in trees:
                    continue
                found = np.zeros((len(at), len(trees[dim])), np.int64)
                for p, _, _, entry, distance in assigned(trees[dim], integers(matrix), dim):
                    found[:, p] = entry
                    error[at] += distance
                for i, c in zip(at.tolist(), found.tolist(), strict=True):
                    code[i], name[i] = c, names[dim]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(code, pa.list_(pa.int32())), pa.array(error, pa.int64()), pa.array(name, pa.string())], names=["doc", "code", "error", "codebooks_sha256"])

    schema = packing.extended(rows.select("doc"), "code array<int>, error long, codebooks_sha256 string")
    return rows.select("doc", "v").mapInArrow(run, schema).where("code IS NOT NULL")


def decoded(code: list[int], parts: list[np.ndarray]) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([b[e] for e, b in zip(code, parts, strict=True)])


def code_text(code: Column) -> Column:
    """Entries as two hexadecimal digits each."""
    return F.array_join(F.transform(code, lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")


def with_group_error(rows: DataFrame, group: str, error: str = "error", name: str = "label_error", most: int = BROADCAST_GROUPS) -> DataFrame:
    """Rows with the error summed over all rows of their group, nulls being one.

    Sums are made before anything is shuffled.  They are written and counted: up to ``most``
    of them are broadcast, so the rows of a large group stay where they are; more of them are
    joined by a shuffle, whose large partitions Spark splits."""
    sums = rows.groupBy(F.col(group).alias("_group")).agg(F.sum(F.col(error).cast("decimal(38,0)")).cast("long").alias(name))
    sums = packing.written(sums, "group-errors")
    joined = F.broadcast(sums) if sums.count() <= most else sums
    return rows.join(joined, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


