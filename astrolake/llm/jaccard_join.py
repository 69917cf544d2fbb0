"""N-gram Jaccard join by token-combination prefixes.

A document's set is its distinct k-word shingles (tokens).  Two sets x, y with
``100 * |x & y| >= threshold * |x | y|`` share at least ceil(threshold/100 * |x|)
tokens of x.  All tokens stand in one order, rare before frequent.  Walk x in that
order and sum up coverage: a rare token covers 1; the tokens of a *class* of
frequent ones cover one less than there are.  Once the prefix covers
|x| - needed + 1, a partner must share a rare token of it or two tokens of one
class of it (else more than |x| - needed tokens would be missing), and the same
holds from the partner's side.  So rare tokens are indexed singly and frequent
ones by pairs within a class, over a prefix that is extended for what the classes
lose.  Classes are small: a frequent token's class is its hash modulo a number
that follows the size level of the set, so pairs stay in proportion to the set.
Partners' levels differ by one at most; every set indexes under its own level and
the one below.

Steps: (1) equal sets become one node; (2) exact corpus counts name the frequent
tokens, a list bounded by ``MAX_FREQUENT``: the least count of a frequent token is
raised until the list fits; (3) prefixes are exchanged as packed blobs, and
members of an index entry become candidate pairs: all pairs of a small entry,
a star of a large one; (4) sketches, upper bounds of intersections, rule out what cannot
be similar; (5) for large entries whose members are not yet one component of candidate
pairs, the pairs across components that sketches allow become candidates as well, so
every link lies inside a component of candidates; (6) the sets of these components, and no
others, meet once, in blocks, where exact intersections give each set's number of links
and what is connected; (7) components by repeated minimum labels.

Sets are compared token by token, by 64-bit hashes of words and shingles; equal sets are
found by a 64-bit hash of the set.

Defined cases: null or wordless texts have an empty set, no link and are their own
component; texts below k words are one shingle; repeated doc_ids and rows each get
their row; a null doc_id never names a component unless all of it is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.llm import packing, textops

K, THRESHOLD = 5, 75
#: Entries up to this many members yield all their pairs at once.
SMALL = 16
#: A token in at least this many sets is frequent, unless the list would not fit.
FREQUENT = 16
MAX_FREQUENT = 1 << 20
#: Tokens a task of the reduce side handles.
BUCKET_TOKENS = 1 << 20
#: Members of a large entry that stand against each other in one group.
BLOCK = 2048
#: Members and tokens of a component in one block when links are counted.
COUNT_BLOCK, COUNT_TOKENS = 1024, 1 << 20
#: Tokens in more members than this are counted by a matrix product.
COUNT_DENSE = 16
#: Rows of nodes up to this many are broadcast (some thirty bytes each); beyond it they are joined by a shuffle.
BROADCAST_NODES = 1 << 19

_CUT = np.uint64(24)


def needed(n, threshold: int = THRESHOLD):
    """Tokens of a set of n that any partner shares."""
    return -(-(n * threshold) // 100)


def similar(common: int, a: int, b: int, threshold: int = THRESHOLD) -> bool:
    return 100 * common >= threshold * (a + b - common)


def signature(tokens: np.ndarray) -> int:
    """64-bit name of a set, as a signed integer."""
    if not len(tokens):
        return 0
    a = textops.mix(tokens + np.uint64(len(tokens)))
    h = textops.mix(textops.mix(a.sum(dtype=np.uint64, keepdims=True)) + np.bitwise_xor.reduce(a))[0]
    return int(np.int64(np.uint64(h).view(np.int64))) or 1


def _sets(batches: Iterator[pa.RecordBatch], text: str, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in textops.pieces(batch, text):
            data, offsets = textops.raw(part.column(text))
            yield part, textops.shingle_sets(textops.Words(data, offsets, textops.BLANK_WORD), k)


def sketch(tokens: np.ndarray) -> bytes:
    """Token counts by hash in |set| / 2 to |set| cells: an upper bound of any intersection.  Empty if a cell overflows."""
    cells = 1 << min(14, max(5, len(tokens).bit_length() - 1))
    counts = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return b"" if counts.max(initial=0) > 255 else counts.astype(np.uint8).tobytes()


def bound(a: bytes, b: bytes) -> int | None:
    """No intersection of the sketched sets is larger; None if nothing is known."""
    if not a or not b:
        return None
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if len(x) > len(y):
        x, y = y, x
    return int(np.minimum(x, y.reshape(-1, len(x)).sum(axis=0)).sum())


def node_table(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """One row per document: doc_id, key (of its text), n (set size), node (signature; 0: empty set), sketch."""

    def run(batches):
        for part, sets in _sets(batches, "t", k):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())],
                names=["doc_id", "key", "n", "node", "sketch"],
            )

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t")).withColumn("key", F.xxhash64("t")).mapInArrow(run, "doc_id long, key long, n long, node long, sketch binary")


def frequent_tokens(texts: DataFrame, k: int, n_buckets: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 40-bit tokens whose exact document count is at least ``least`` (or more, so that ``most`` fit), and the counts' powers of two in quarters."""

    def count(batches):
        held, size = [], 0

        def flush(held):
            t, c = np.unique(np.concatenate(held) >> _CUT, return_counts=True)
            bucket = ((t >> np.uint64(8)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
            return packing.blob_batch((b, packing.pack(packing.delta(t[s]), np.minimum(c[s], 2**32 - 1).astype(np.uint32))) for b, s in packing.by_bucket(bucket))

        for part, sets in _sets(batches, "t", k):
            held += sets
            size += part.nbytes
            if size >= packing.FLUSH_BYTES:
                made = flush(held)
                held, size = [], 0
                yield packing.released(made)
        if held:
            yield flush(held)

    def total(table: pa.Table) -> pa.Table:
        got = [packing.unpack(b) for b in table.column("blob").to_pylist()]
        t = np.concatenate([packing.undelta(a) for a, _ in got])
        c = np.concatenate([a for _, a in got]).astype(np.int64)
        order = np.argsort(t, kind="stable")
        starts, _ = packing.groups(t[order])
        sums = np.add.reduceat(c[order], starts) if len(starts) else c[:0]
        keep = sums >= least
        return pa.table({"token": pa.array(t[order][starts][keep].view(np.int64), pa.int64()), "df": pa.array(sums[keep], pa.int64())})

    made: list[str] = []
    counted = packing.written(texts.mapInArrow(count, packing.BLOB_SCHEMA).groupBy("bucket").applyInArrow(total, "token long, df long"), "token-counts", made)
    # the least count that lets the list fit, from a histogram by powers of two
    bins = {int(r["b"]): int(r["c"]) for r in counted.groupBy(F.floor(F.log2("df")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}
    cut, fit = least, sum(bins.values())
    for b in sorted(bins):
        if fit <= most:
            break
        fit -= bins[b]
        cut = 2 ** (b + 1)
    found = counted.where(F.col("df") >= cut).select("token", F.floor(F.log2("df") * 4).cast("short").alias("bin")).toArrow()
    packing.drop(texts.sparkSession, made)
    tokens = found.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found.column("bin").to_numpy()[order].astype(np.uint8)


def level(n: int, threshold: int = THRESHOLD) -> int:
    """Partners' levels differ by one at most."""
    return int(np.floor(np.log(n) / np.log(100 / threshold) + 1e-9)) if n else 0


def index_keys(tokens: np.ndarray, frequent: np.ndarray, bins: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, float]:
    """Index keys of a set (rare tokens of the prefix, and pairs within classes of frequent ones), and its share of rare tokens."""
    n = len(tokens)
    need = n - needed(n, threshold) + 1
    short = tokens >> _CUT
    if len(frequent):
        slot = np.searchsorted(frequent, short)
        slot[slot == len(frequent)] = 0
        often = frequent[slot] == short
    else:
        often = np.zeros(n, bool)
    rare = tokens[~often]
    if len(rare) >= need:
        return rare[:need], len(rare) / n
    keys, rest, common = [rare], need - len(rare), tokens[often]
    common = common[np.lexsort((common, bins[slot[often]]))]
    own = level(n, threshold)
    for lv in (own, own - 1):
        classes = max(1, int((100 / threshold) ** lv * (100 - threshold) / 100 / 4))
        # the less frequent come first, then by hash; the class is by other bits
        kind = (textops.mix(common) % np.uint64(classes)).astype(np.int64)
        seen: dict[int, list[int]] = {}
        left = rest
        for t, c in zip(common.tolist(), kind.tolist(), strict=True):
            if left <= 0:
                break
            mates = seen.setdefault(c, [])
            left -= bool(mates)
            mates.append(t)
        pairs = [(x, y) for mates in seen.values() for i, x in enumerate(mates) for y in mates[:i]]
        if pairs:
            p = np.array(pairs, np.uint64)
            keys.append(textops.mix(p[:, 0] * np.uint64(0x9E3779B97F4A7C15) + p[:, 1] + np.uint64(lv + 1000)))
        if left > 0:
            # all of a set's frequent tokens are in the prefix and the classes still lose too much: index them singly as well
            keys.append(common)
    return np.unique(np.concatenate(keys)), len(rare) / n


def candidates(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], k: int, n_buckets: int, threshold: int, small: int = SMALL) -> DataFrame:
    """Candidate rows: kind 0 a pair (a, b); kind 1 a member a of the large entry b."""
    held_frequent = texts.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches):
        often, bins = held_frequent.value
        keys, owners, nodes, sizes, shares, seen, size = [], [], [], [], [], set(), 0

        def flush():
            key, owner = np.concatenate(keys) >> _CUT, np.concatenate(owners)
            node, n, share = np.array(nodes, np.int64), np.array(sizes, np.int64), np.array(shares, np.uint16)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            bucket = ((key >> np.uint64(8)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
            for b, s in packing.by_bucket(bucket):
                used, local = np.unique(owner[s], return_inverse=True)
                yield b, packing.pack(packing.delta(key[s]), local.astype(np.uint32), node[used], n[used], share[used])

        for part, sets in _sets(batches, "t", k):
            for s in sets:
                node = signature(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    found, rare = index_keys(s, often, bins, threshold)
                    keys.append(found)
                    owners.append(np.full(len(found), len(nodes), np.int64))
                    nodes.append(node)
                    sizes.append(len(s))
                    shares.append(int(rare * 65535))
            size += part.nbytes
            if size >= packing.FLUSH_BYTES and keys:
                made = packing.blob_batch(flush())
                keys, owners, nodes, sizes, shares, seen, size = [], [], [], [], [], set(), 0
                yield packing.released(made)
        if keys:
            yield packing.blob_batch(flush())

    def meet(table: pa.Table) -> pa.Table:
        key, node, n, share = [], [], [], []
        for blob in table.column("blob").to_pylist():
            d, local, nodes, sizes, shares = packing.unpack(blob)
            key.append(packing.undelta(d))
            node.append(nodes[local])
            n.append(sizes[local])
            share.append(shares[local])
        key, node, n, share = np.concatenate(key), np.concatenate(node), np.concatenate(n), np.concatenate(share)
        order = np.lexsort((node, n, key))
        key, node, n, share = key[order], node[order], n[order], share[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n, share = key[keep], node[keep], n[keep], share[keep]
        starts, group = packing.groups(key)
        count = np.diff(np.r_[starts, len(key)])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # members stand by size: the i-th and the (i+step)-th of a small entry
        for step in range(1, small):
            i = np.arange(len(key) - step)
            ok = (group[i] == group[i + step]) & (count[group[i]] <= small) & (needed(n[i + step], threshold) <= n[i])
            left.append(node[i[ok]])
            right.append(node[i[ok] + step])
        member, entry = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        known = set()
        for g in np.flatnonzero(count > small):
            a, b = starts[g], starts[g] + count[g]
            name = int(textops.mix(np.array([np.bitwise_xor.reduce(textops.mix(node[a:b].view(np.uint64))) + np.uint64(b - a)], np.uint64)).view(np.int64)[0])
            if name in known:
                continue
            known.add(name)
            # copies of one text have few rare tokens, their original none: the same hub in all their entries
            hub = a + int(np.lexsort((node[a:b], share[a:b]))[0])
            near = np.flatnonzero((needed(np.maximum(n[a:b], n[hub]), threshold) <= np.minimum(n[a:b], n[hub])) & (node[a:b] != node[hub])) + a
            left.append(node[near])
            right.append(np.full(len(near), node[hub]))
            member.append(node[a:b])
            entry.append(np.full(b - a, name))
        x, y = np.concatenate(left), np.concatenate(right)
        p = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        m, e = np.concatenate(member), np.concatenate(entry)
        kind = np.r_[np.zeros(len(p), np.int32), np.ones(len(m), np.int32)]
        return packing.released(pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(np.r_[p[:, 0], m], pa.int64()), "b": pa.array(np.r_[p[:, 1], e], pa.int64())}))

    return texts.mapInArrow(emit, packing.BLOB_SCHEMA).groupBy("bucket").applyInArrow(meet, "kind int, a long, b long")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_NODES else df


def sketches_of(table: DataFrame, wanted: DataFrame, made: list[str]) -> DataFrame:
    """(node, n, sketch) of the wanted nodes."""
    wanted = packing.written(wanted, "wanted-nodes", made)
    rows = table.join(small(wanted, wanted.count()), "node", "left_semi")
    return packing.written(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches", made)


def plausible(pairs: DataFrame, table: DataFrame, threshold: int, made: list[str]) -> DataFrame:
    """Pairs whose sketches do not rule the link out.  Only the sketches of nodes in pairs are moved."""

    def run(batches):
        for batch in batches:
            keep = []
            for na, nb, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
                most = bound(sa, sb)
                keep.append(most is None or similar(most, na, nb, threshold))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    nodes = sketches_of(table, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), made)
    sa = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    sb = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(sa, "a").join(sb, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


class Sketches:
    """Sketches of several sets, folded to a common number of cells where two are compared."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.cells, self.folded = raw, np.array([len(x) for x in raw], np.int64), {}

    def _at(self, cells: int) -> np.ndarray:
        if cells not in self.folded:
            table = np.zeros((len(self.raw), cells), np.uint16)
            for i in np.flatnonzero(self.cells >= cells):
                table[i] = np.frombuffer(self.raw[i], np.uint8).reshape(-1, cells).sum(axis=0, dtype=np.uint16)
            self.folded[cells] = table
        return self.folded[cells]

    def most_common(self, x: np.ndarray, y: np.ndarray, unknown: np.ndarray, coarse: int = 1) -> np.ndarray:
        """Upper bounds of the intersections of sets x[i] and y[i]; ``unknown`` where a sketch is missing.  ``coarse`` times fewer cells are quicker and bound less."""
        out, cells = unknown.copy(), np.minimum(self.cells[x], self.cells[y])
        cells = np.where(cells > 0, np.maximum(cells // coarse, 16), 0)
        for c in np.unique(cells[cells > 0]):
            table, at = self._at(int(c)), np.flatnonzero(cells == c)
            step = max(1, (1 << 22) // int(c))
            for i in range(0, len(at), step):
                j = at[i : i + step]
                out[j] = np.minimum(table[x[j]], table[y[j]]).sum(axis=1, dtype=np.int64)
        return out


def across(members: DataFrame, n_buckets: int, threshold: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of members of one entry in different components that sizes and sketches allow, from (entry, node, component, n, sketch).

    An entry of more than ``block`` members is cut into blocks, and every two blocks meet
    in a group of their own, so no group exceeds two blocks."""
    sizes = members.groupBy("entry").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks"))
    dealt = members.join(sizes, "entry").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("entry", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "component", "n", "sketch")

    def run(table: pa.Table) -> pa.Table:
        entry, low, high, mine, node, comp, n = (table.column(c).to_numpy() for c in ("entry", "low", "high", "mine", "node", "component", "n"))
        raw = table.column("sketch")
        order = np.lexsort((comp, high, low, entry))
        starts, _ = packing.groups(entry[order], low[order], high[order])
        found, waiting = [np.zeros((0, 2), np.int64)], 0
        for a, b in zip(starts, np.r_[starts[1:], len(order)], strict=True):
            o = order[a:b]
            v, c, z, m = node[o], comp[o], n[o], mine[o]
            apart = low[o[0]] < high[o[0]]
            names, counts = np.unique(c, return_counts=True)
            minor = np.flatnonzero(c != names[np.argmax(counts)])
            sketches = Sketches(raw.take(pa.array(o)).to_pylist()) if len(minor) else None
            for i in range(0, len(minor), 256):
                x, y = minor[i : i + 256, None], np.arange(len(v))[None]
                ok = (c[x] != c[y]) & (threshold * np.maximum(z[x], z[y]) <= 100 * np.minimum(z[x], z[y]))
                if apart:
                    ok &= m[x] != m[y]
                i_x, i_y = np.nonzero(ok)
                x, y = minor[i : i + 256][i_x], i_y
                for coarse in (8, 1):
                    most = sketches.most_common(x, y, np.minimum(z[x], z[y]), coarse)
                    keep = 100 * most >= threshold * (z[x] + z[y] - most)
                    x, y = x[keep], y[keep]
                p, q = v[x], v[y]
                found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1))
                waiting += len(p)
            if waiting > 1 << 20:
                found, waiting = [np.unique(np.concatenate(found), axis=0)], 0
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return dealt.withColumn("_part", F.pmod(F.xxhash64("entry", "low", "high"), F.lit(n_buckets))).groupBy("_part").applyInArrow(run, "a long, b long")


def components(edges: DataFrame, made: list[str], name: str = "components") -> DataFrame:
    """(node, component) of every node of the edges (a, b): minimum labels by alternating large and small stars."""
    spark, before = edges.sparkSession, []
    edges = packing.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name, before)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: greater neighbours point to the minimum
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself point to the minimum
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = []
        after = packing.written(star, name, now)
        packing.drop(spark, before)
        # done when every node has one parent and no parent has a parent
        bad = after.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("u").unionByName(after.select("u").join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi"))
        edges, before = after, now
        if bad.isEmpty():
            made += now
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def common_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets."""
    m = len(sets)
    token, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    starts, group = packing.groups(token)
    count = np.diff(np.r_[starts, len(token)])
    out = np.zeros(m * m, np.int64)
    few = count[group] <= COUNT_DENSE
    t, o = token[few], owner[few]
    for step in range(1, COUNT_DENSE):
        same = np.flatnonzero(t[step:] == t[:-step])
        if not len(same):
            break
        np.add.at(out, o[same] * m + o[same + step], 1)
    out = out.reshape(m, m)
    out = out + out.T
    often = np.flatnonzero(count > COUNT_DENSE)
    width = max(64, (1 << 22) // m)
    for i in range(0, len(often), width):
        part = often[i : i + width]
        column = np.repeat(np.arange(len(part)), count[part])
        at = np.concatenate([np.arange(starts[g], starts[g] + count[g]) for g in part])
        held = np.zeros((m, len(part)), np.float32)
        held[owner[at], column] = 1
        out += (held @ held.T).astype(np.int64)
    return out


def connected(ok: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row that it is connected to."""
    out = np.full(len(ok), -1, np.int64)
    for i in range(len(ok)):
        if out[i] < 0:
            out[i], edge = i, np.array([i])
            while len(edge):
                edge = np.flatnonzero(ok[edge].any(axis=0) & (out < 0))
                out[edge] = i
    return out


def exact_links(texts: DataFrame, table: DataFrame, groups: DataFrame, made: list[str], k: int, n_buckets: int, threshold: int, block: int = COUNT_BLOCK, tokens: int = COUNT_TOKENS) -> DataFrame:
    """(node, other, n_links) from (node, component) of candidates and the ``table`` of nodes: sets found similar to others of their component.

    A component of more than ``block`` sets or ``tokens`` tokens is cut into blocks, and
    every two blocks meet in a group of their own; each group returns, for each of its sets
    with links, how many and one set that it is connected to."""
    groups = packing.written(groups, "candidate-groups", made)
    wide = table.select("node", "n", "key").join(small(groups, groups.count()), "node").groupBy("node", "component").agg(F.first("n").alias("n"), F.min("key").alias("key"))
    wide = packing.written(wide, "candidate-sets", made)
    sizes = wide.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("n") / F.lit(tokens))).alias("blocks"))
    wanted = packing.written(wide.join(sizes, "component").select("key", "component", "blocks"), "candidate-keys", made)

    def emit(batches):
        seen = set()
        for part, sets in _sets(batches, "t", k):
            names = [signature(s) for s in sets]
            new = [i for i, v in enumerate(names) if v not in seen and not seen.add(v)]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in new], pa.int64()), pa.array([packing.pack(packing.delta(sets[i])) for i in new], pa.binary()), *(part.column(c).take(pa.array(new, pa.int64())) for c in ("component", "blocks"))], names=["node", "tokens", "component", "blocks"])

    dealt = texts.join(small(wanted, wanted.count()), "key").select("t", "component", "blocks").mapInArrow(emit, "node long, tokens binary, component long, blocks long")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # small components share a group; two blocks of a large one have theirs
    dealt = dealt.select(
        (F.col("blocks") > 1).alias("large"),
        F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(4 * n_buckets))).alias("part"),
        F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "component", "node", "tokens",
    )

    def run(table: pa.Table) -> pa.Table:
        low, high, mine, comp, node = (table.column(c).to_numpy() for c in ("low", "high", "mine", "component", "node"))
        raw = table.column("tokens")
        order = np.lexsort((node, comp))
        keep = np.ones(len(order), bool)
        keep[1:] = node[order][1:] != node[order][:-1]
        order = order[keep]
        starts, _ = packing.groups(comp[order])
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        for a, b in zip(starts, np.r_[starts[1:], len(order)], strict=True):
            o = order[a:b]
            sets = [packing.undelta(packing.unpack(x)[0]) for x in raw.take(pa.array(o)).to_pylist()]
            n, common = np.array([len(s) for s in sets], np.int64), common_tokens(sets)
            ok = 100 * common >= threshold * (n[:, None] + n[None] - common)
            np.fill_diagonal(ok, False)
            if low[o[0]] < high[o[0]]:
                ok &= mine[o][:, None] != mine[o][None]
            count = ok.sum(axis=1)
            for held, found in zip(out, (node[o], node[o][connected(ok)], count), strict=True):
                held.append(found[count > 0])
        return packing.released(pa.table(dict(zip(("node", "other", "n_links"), (pa.array(np.concatenate(x), pa.int64()) for x in out), strict=True))))

    return packing.written(dealt.groupBy("large", "part", "low", "high").applyInArrow(run, "node long, other long, n_links long"), "links")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, threshold: int = THRESHOLD, bucket_tokens: int = BUCKET_TOKENS, frequent: int = FREQUENT, max_frequent: int = MAX_FREQUENT, all_pairs: int = SMALL, block: int = BLOCK, count_block: int = COUNT_BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_verified (different other texts it is similar to)."""
    texts = docs.select(F.col(f"`{text}`").alias("t")).withColumn("key", F.xxhash64("t"))
    n_rows, size = packing.text_size(texts, "t")
    n_buckets = packing.bucket_count(size // 6, bucket_tokens)
    table = packing.written(node_table(docs, doc_id, text, k), "nodes")
    often = frequent_tokens(texts, k, n_buckets, frequent, max_frequent)
    made: list[str] = []
    found = packing.written(candidates(texts, often, k, n_buckets, threshold, all_pairs), "candidates", made)
    pairs = packing.written(plausible(found.where("kind = 0").select("a", "b").distinct(), table, threshold, made), "pairs", made)
    groups = components(pairs, made)
    # large entries that are not yet one component: pairs across components that may be similar
    members = found.where("kind = 1").select(F.col("b").alias("entry"), F.col("a").alias("node")).distinct()
    members = members.join(groups, "node", "left").select("entry", "node", F.coalesce("component", "node").alias("component"))
    split = members.groupBy("entry").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("entry")
    open_members = packing.written(members.join(split, "entry"), "open-entries", made)
    if not open_members.isEmpty():
        cross = packing.written(across(open_members.join(sketches_of(table, open_members.select("node").distinct(), made), "node"), n_buckets, threshold, block).distinct(), "cross", made)
        if not cross.isEmpty():
            groups = components(pairs.unionByName(cross), made)
    links = exact_links(texts, table, groups, made, k, n_buckets, threshold, count_block)
    packing.drop(docs.sparkSession, made)
    linked = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")), made)
    # what is not a document of its own: nodes with copies or links; all else needs no join on a key that many rows share
    per_node = table.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    ends = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    special = per_node.join(linked, "node", "left").join(ends, "node", "left").where("copies > 1 OR component IS NOT NULL")
    special = packing.written(special.select("node", F.coalesce("component", "node").alias("component"), "least_id", "n_links"), "grouped-nodes")
    few = special.count()
    least = special.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = special.join(small(least, few), "component").select("node", "component_id", "n_links")
    return table.join(small(named, few), "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_verified")
    )


#: Removed ids up to this many are broadcast (eight bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Of each component the documents with the smallest id stay; rows with a null id stay."""
    found = packing.written(jaccard_components(docs, doc_id, text, **options).select("doc_id", "component_id"), "components")
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_lost")).distinct()
    few = lost.count() <= BROADCAST_IDS
    rows = packing.wrapped(docs, _id=doc_id)
    return rows.join(F.broadcast(lost) if few else lost, F.col("_id").cast("long") == F.col("_lost"), "left_anti").select("doc.*")
