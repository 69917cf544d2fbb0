"""Exact substring dedup over a sparse suffix array.

Every byte covered by a ``span``-byte string that also starts in a document with
a smaller doc_id is removed.  Documents are UTF-8 bytes; matches never cross
documents; strings are judged on the input, and only bytes that were compared are removed.

Sorting every suffix of a corpus would move it many times over.  Suffixes are
sampled by content instead: of all ``TOKEN``-byte tokens inside a ``span``-byte window
the one with the least hash is its anchor, so equal windows have equal anchors,
and about one suffix in eighteen is kept.  Consecutive windows with one anchor form a *run*.

1. Hashes of anchors are exchanged, to find those that several documents share.  This
   only leaves out suffixes that can match nothing; what it lets through by chance is
   compared later.  A token that two documents of one flush share travels once.
2. A bounded sample of anchors gives splitters.  Shared suffixes, with the bytes of their
   run, are range-partitioned by their leading token.  Before the exchange a task sorts
   what it holds; of equal runs only those of the smallest document go on.
3. Each range bucket sorts its suffixes by multikey quicksort (characters of eight bytes).
   Suffixes that are neighbours with one leading token, but of different documents, are
   compared: equal runs by one more sort, and of what is left all windows, sorted alike.
   Of equal windows those outside the smallest document are repeats.
4. Splitters are whole tokens, so suffixes on both sides of a boundary differ in their
   leading token, unless a token is so frequent in the sample that one bucket should not
   hold it: its suffixes are dealt to all buckets window by window, by the hash of the
   window, which is how windows on both sides of such boundaries are compared.
5. Marks are united per document and the remaining bytes are kept.

Defined cases: null text is empty; texts shorter than ``span`` keep all; a null
doc_id counts as 2**63 - 1, the largest; rows with one doc_id never remove each other;
other columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.llm import packing, textops

SPAN, TOKEN = 50, 16
#: Text bytes behind one bucket of suffixes, and behind one group of rows.
BUCKET_BYTES, ROW_BYTES = 12 << 20, 4 << 20
#: Anchors sampled for each range, anchors taken of a row, and ranges at most; more buckets part a range by token.
SAMPLE, SAMPLE_EACH, MAX_RANGES = 64, 50, 1 << 14
#: Different runs of one token in the sample from which it is dealt by window.
HOT = 16
#: Windows compared at a time.
WINDOWS = 1 << 18

_NULL_ID = np.iinfo(np.int64).max
_CUT = np.uint64(24)


def runs(data: np.ndarray, offsets: np.ndarray, span: int):
    """Runs of windows with one anchor: row, first and last+1 window start, place of the anchor, hash of its token."""
    n, width = len(data), span - TOKEN + 1
    windows = n - span + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return none, none, none, none, none.astype(np.uint64)
    view = textops.eights(data)
    m = n - TOKEN + 1
    grams = textops.mix(textops.mix(view[:m] + np.uint64(0x9E3779B97F4A7C15)) + view[8 : m + 8])
    low, step = grams, 1
    while step * 2 <= width:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    least = np.minimum(low[:windows], low[width - step : width - step + windows])
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)[:windows]
    inside = np.arange(windows) + span <= offsets[row + 1]
    new = np.ones(windows, bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
    start = np.flatnonzero(new)
    end = np.r_[start[1:], windows]
    start, end = start[inside[start]], end[inside[start]]
    token, at, todo = least[start], start.copy(), np.arange(len(start))
    for ahead in range(width):
        hit = grams[start[todo] + ahead] == token[todo]
        at[todo[hit]] = start[todo[hit]] + ahead
        todo = todo[~hit]
        if not len(todo):
            break
    return row[start], start, end, at, textops.mix(token)  # least hashes are small ones: spread again


def multikey_order(view: np.ndarray, at: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the strings ``at`` .. ``at + length`` inside each group, with eight bytes as one character.

    Strings of one group are of one length.  Only what is still tied goes into the next
    round.  Returns the order, and numbers that are equal for equal strings."""
    order = np.argsort(group, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = group[order][1:] != group[order][:-1]
    tied, depth = np.arange(len(order)), 0
    while True:
        first = new[tied]
        tied = tied[~first | np.r_[~first[1:], False]] if len(tied) else tied
        tied = tied[length[order[tied]] > depth]
        if not len(tied):
            return order, np.cumsum(new) - 1
        o = order[tied]
        left = np.minimum(length[o] - depth, 8)
        key = view[at[o] + depth].astype(np.uint64) >> (np.uint64(8) * (8 - left).astype(np.uint64))
        number = np.cumsum(new[tied])
        by = np.lexsort((key, number))
        order[tied], key = o[by], key[by]
        new[tied[1:]] |= key[1:] != key[:-1]
        depth += 8


def repeated_runs(view, at, length, group, doc) -> tuple[np.ndarray, np.ndarray]:
    """Order of the runs, and which of them equal a run of a smaller document."""
    order, same = multikey_order(view, at, length, group)
    starts, _ = packing.groups(same)
    least = np.minimum.reduceat(doc[order], starts) if len(starts) else doc[:0]
    return order, doc[order] > least[same]


def repeated_windows(view, at, count, group, doc, span: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(run, window) of all windows that equal a window of a smaller document in the same group.

    More than ``most`` windows are parted by their bytes, and one part is sorted at a time."""
    parts = -(-int(count.sum()) // most)
    edges = np.r_[0, np.flatnonzero(np.diff(np.cumsum(count) // most)) + 1, len(at)] if parts > 1 else np.array([0, len(at)])
    for part in range(parts):
        owner, inner = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            o = np.repeat(np.arange(a, b), count[a:b])
            i = np.arange(len(o)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
            if parts > 1:
                h = np.zeros(len(o), np.uint64)
                for depth in range(0, span - 7, 8):
                    h = textops.mix(h ^ view[at[o] + i + depth].astype(np.uint64))
                mine = h % np.uint64(parts) == part
                o, i = o[mine], i[mine]
            owner.append(o)
            inner.append(i)
        owner, inner = np.concatenate(owner), np.concatenate(inner)
        order, same = multikey_order(view, at[owner] + inner, np.full(len(owner), span, np.int64), group[owner])
        starts, _ = packing.groups(same)
        if len(starts):
            d = doc[owner][order]
            found = order[d > np.minimum.reduceat(d, starts)[same]]
            yield owner[found], inner[found]


def joined(owner: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first, last + 1) of consecutive windows."""
    order = np.lexsort((inner, owner))
    owner, inner = owner[order], inner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(owner)] - 1 if len(first) else first
    return owner[first], inner[first], inner[last] + 1


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)


def _leads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The tokens at some places, as bytes that sort."""
    out = np.empty((len(at), 2), ">u8")
    view = textops.eights(data, ">")
    out[:, 0], out[:, 1] = view[at], view[at + 8]
    return out.reshape(-1).view("S16")


class Plan:
    """Where suffixes go: range splitters, tokens that are dealt by window, and numbers of buckets."""

    def __init__(self, cuts: np.ndarray, hot: np.ndarray, parts: int, buckets: int):
        self.cuts, self.hot, self.parts, self.buckets = cuts, hot, parts, buckets

    def is_hot(self, leads: np.ndarray) -> np.ndarray:
        return np.isin(leads, self.hot) if len(self.hot) else np.zeros(len(leads), bool)

    def bucket(self, leads: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.cuts, leads, "right").astype(np.int64) * self.parts
        if self.parts > 1:
            two = np.frombuffer(leads.tobytes(), np.uint64).reshape(-1, 2)
            at += (textops.mix(two[:, 0] + textops.mix(two[:, 1])) % np.uint64(self.parts)).astype(np.int64)
        return at


def plan_of(texts: DataFrame, n_rows: int, size: int, bucket_bytes: int, span: int) -> Plan:
    """Splitters between about equal ranges of leading tokens, from a bounded sample of rows."""
    wanted = packing.bucket_count(size, bucket_bytes)
    ranges = min(wanted, MAX_RANGES)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in textops.pieces(batch, "text"):
                data, offsets = textops.raw(part.column("text"))
                _, start, end, at, _ = runs(data, offsets, span)
                take = slice(None, None, max(1, len(start) // (SAMPLE_EACH * part.num_rows)))
                covered = textops.span_hashes(data, start[take], end[take] - 1 + span)
                yield pa.RecordBatch.from_arrays([pa.array(_leads(data, at[take]).tolist(), pa.binary()), pa.array(covered.view(np.int64))], names=["lead", "run"])

    share = min(1.0, max(40, SAMPLE * ranges / SAMPLE_EACH) / max(n_rows, 1))
    few = texts.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    got = few.mapInArrow(run, "lead binary, run long").distinct().toArrow()
    lead = np.sort(np.array(got.column("lead").to_pylist(), "S16"))
    if not len(lead):
        return Plan(lead, lead, 1, ranges)
    names, counts = np.unique(lead, return_counts=True)
    cuts = np.unique(lead[np.linspace(0, len(lead) - 1, ranges + 1).astype(np.int64)[1:-1]])
    parts = -(-wanted // ranges)
    return Plan(cuts, names[counts >= max(HOT, len(lead) / (4 * ranges))], parts, (len(cuts) + 1) * parts)


def _span_rows(n_groups: int, ids, keys, row, *columns):
    """Blobs (bucket of rows, rows, and their spans), from spans of rows numbered by ``row``."""
    used, local = np.unique(row, return_inverse=True)
    bucket = (keys[used] % n_groups)[local]
    order = np.lexsort((columns[0], local, bucket))
    for b, s in packing.by_bucket(bucket[order]):
        o = order[s]
        mine, near = np.unique(local[o], return_inverse=True)
        yield b, packing.pack(ids[used[mine]], keys[used[mine]], near.astype(np.uint32), *[c[o].astype(np.uint32) for c in columns])


def shared_anchors(texts: DataFrame, n_buckets: int, n_groups: int, span: int) -> DataFrame:
    """Per group of rows: runs whose anchor token occurs in another document as well (row, start, windows, place of the anchor)."""

    def emit(batches):
        held, size, rows = [], 0, 0

        def flush():
            ids, keys = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            row, start, count, ahead, token = (np.concatenate([h[i] for h in held]) for i in range(2, 7))
            order = np.lexsort((row, token))
            row, start, count, ahead, token = row[order], start[order], count[order], ahead[order], token[order]
            starts, group = packing.groups(token)
            doc = ids[row]
            known = (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts))[group] if len(starts) else np.zeros(0, bool)
            if known.any():
                yield from ((-1 - b, blob) for b, blob in _span_rows(n_groups, ids, keys, row[known], start[known], count[known], ahead[known]))
            # a token known to be shared is named once, the others with all that is needed to ask for them
            bucket = ((token >> np.uint64(8)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
            once = np.zeros(len(token), bool)
            once[starts] = known[starts] if len(starts) else False
            for b, s in packing.by_bucket(bucket):
                n, t = np.flatnonzero(once[s]) + s.start, np.flatnonzero(~known[s]) + s.start
                used, local = np.unique(row[t], return_inverse=True)
                yield b, packing.pack(packing.delta(token[n]), packing.delta(token[t]), local.astype(np.uint32), start[t].astype(np.uint32), count[t].astype(np.uint32), ahead[t].astype(np.uint32), ids[used], keys[used])

        for batch in batches:
            for part in textops.pieces(batch, "text"):
                data, offsets = textops.raw(part.column("text"))
                row, start, end, at, token = runs(data, offsets, span)
                held.append((_ids(part.column("id")), part.column("key").to_numpy(), row + rows, start - offsets[row], end - start, at - start, token >> _CUT))
                rows += part.num_rows
                size += len(data)
                if size >= packing.FLUSH_BYTES:
                    made = packing.blob_batch(flush())
                    held, size, rows = [], 0, 0
                    yield packing.released(made)
        if held:
            yield packing.blob_batch(flush())

    def meet(table: pa.Table) -> pa.Table:
        got = [packing.unpack(b) for b in table.column("blob").to_pylist()]
        if table.column("bucket")[0].as_py() < 0:
            return table.set_column(0, "bucket", pa.array([-1 - b for b in table.column("bucket").to_pylist()], pa.int64()))
        base = np.cumsum([0, *(len(g[6]) for g in got)])
        known = np.unique(np.concatenate([packing.undelta(g[0]) for g in got]))
        token = np.concatenate([packing.undelta(g[1]) for g in got])
        row = np.concatenate([g[2] + b for g, b in zip(got, base, strict=False)]).astype(np.int64)
        start, count, ahead, ids, keys = (np.concatenate([g[i] for g in got]) for i in range(3, 8))
        order = np.argsort(token, kind="stable")
        starts, group = packing.groups(token[order])
        if not len(starts):
            return pa.Table.from_batches([packing.blob_batch([])])
        doc = ids[row[order]]
        several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        several |= np.isin(token[order][starts], known, assume_unique=True)
        ask = order[several[group]]
        return packing.released(pa.Table.from_batches([packing.blob_batch(_span_rows(n_groups, ids, keys, row[ask], start[ask], count[ask], ahead[ask]))]))

    return texts.mapInArrow(emit, packing.BLOB_SCHEMA).groupBy("bucket").applyInArrow(meet, packing.BLOB_SCHEMA)


def _spans(table: pa.Table, columns: int):
    """Rows (doc_id, key) of span blobs and the spans of each, sorted by row."""
    got = [packing.unpack(b) for b in table.column("blob").to_pylist()]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.int64)] * columns
    ids, keys = np.concatenate([g[0][g[2]] for g in got]), np.concatenate([g[1][g[2]] for g in got])
    spans = [np.concatenate([g[3 + i] for g in got]).astype(np.int64) for i in range(columns)]
    order = np.lexsort((spans[0], keys, ids))
    return ids[order], keys[order], [s[order] for s in spans]


def _of_rows(ids, keys, row_ids, row_keys) -> tuple[np.ndarray, np.ndarray]:
    """From where to where the spans of each row stand in arrays sorted by (id, key)."""
    starts, _ = packing.groups(ids, keys)
    bounds = {(i, k): (a, b) for i, k, a, b in zip(ids[starts].tolist(), keys[starts].tolist(), starts.tolist(), np.r_[starts, len(ids)][1:].tolist(), strict=True)}
    found = np.array([bounds.get(x, (0, 0)) for x in zip(row_ids.tolist(), row_keys.tolist(), strict=True)], np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def fetch_runs(rows: DataFrame, asked: DataFrame, plan: Plan, n_groups: int, span: int) -> DataFrame:
    """Bytes of the shared runs, sent to the bucket of their leading token; and marks of those already known to repeat (buckets below zero)."""
    held_plan = rows.sparkSession.sparkContext.broadcast(plan)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([packing.blob_batch([])])
        plan, out = held_plan.value, []
        ids, keys, (start, count, ahead) = _spans(right, 3)
        left = left.combine_chunks()
        row_ids, row_keys = _ids(left.column("id").combine_chunks()), left.column("key").to_numpy()
        data, offsets = textops.raw(left.column("text").combine_chunks())
        low, high = _of_rows(ids, keys, row_ids, row_keys)
        # equal rows ask once
        first = np.zeros(len(row_ids), bool)
        first[np.unique(np.stack([row_ids, row_keys]), axis=1, return_index=True)[1]] = True
        high = np.where(first, high, low)
        row = np.repeat(np.arange(len(row_ids)), high - low)
        which = np.arange(len(row)) + np.repeat(low - np.r_[0, np.cumsum(high - low)[:-1]], high - low)
        start, count, ahead = start[which], count[which], ahead[which]
        view = textops.eights(data, ">")
        leads = _leads(data, offsets[row] + start + ahead)
        hot = plan.is_hot(leads)
        if hot.any():
            # a run of a hot token goes window by window, each by its own first bytes: the token may stand in it several times
            owner = np.repeat(np.arange(len(row)), np.where(hot, count, 1))
            inner = np.arange(len(owner)) - np.searchsorted(owner, owner)
            row, start, ahead, leads, hot = row[owner], start[owner] + inner, np.where(hot[owner], 0, ahead[owner]), leads[owner], hot[owner]
            count = np.where(hot, 1, count[owner])
        at, length = offsets[row] + start, count + span - 1
        order, repeat = repeated_runs(view, at, length, length, row_ids[row])
        gone, go = order[repeat], order[~repeat]
        if len(gone):
            out += [(-1 - b, blob) for b, blob in _span_rows(n_groups, row_ids, row_keys, row[gone], start[gone], length[gone])]
        bucket = plan.bucket(leads[go])
        if hot.any():
            warm = hot[go]
            bucket[warm] = (textops.span_hashes(data, at[go][warm], at[go][warm] + span) % np.uint64(plan.buckets)).astype(np.int64)
        by = np.lexsort((leads[go], bucket))
        go, bucket = go[by], bucket[by]
        for b, s in packing.by_bucket(bucket):
            o = go[s]
            used, local = np.unique(row[o], return_inverse=True)
            body = data[np.repeat(at[o] - np.r_[0, np.cumsum(length[o])[:-1]], length[o]) + np.arange(int(length[o].sum()))]
            out.append((b, packing.pack(row_ids[used], row_keys[used], local.astype(np.uint32), start[o].astype(np.uint32), count[o].astype(np.uint32), ahead[o].astype(np.uint32), body)))
        return packing.released(pa.Table.from_batches([packing.blob_batch(out)]))

    return rows.groupBy("group").cogroup(asked.groupBy("bucket")).applyInArrow(run, packing.BLOB_SCHEMA)


def compare_suffixes(fetched: DataFrame, n_groups: int, span: int, windows: int = WINDOWS) -> DataFrame:
    """Marks (start and length of bytes that repeat) per group of rows, from the sorted suffixes of each bucket."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.set_column(0, "bucket", pa.array([-1 - b for b in table.column("bucket").to_pylist()], pa.int64()))
        got = [packing.unpack(b) for b in table.column("blob").to_pylist()]
        ids, keys = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        base = np.cumsum([0, *(len(g[0]) for g in got)])
        row = np.concatenate([g[2] + b for g, b in zip(got, base, strict=False)]).astype(np.int64)
        start, count, ahead = (np.concatenate([g[i] for g in got]).astype(np.int64) for i in (3, 4, 5))
        data = np.concatenate([g[6] for g in got])
        del got
        view, length, doc = textops.eights(data, ">"), count + span - 1, ids[row]
        at = np.cumsum(length) - length
        # suffixes in order of their leading token; those that no other document shares are done
        order, token = multikey_order(view, at + ahead, np.full(len(at), TOKEN, np.int64), np.zeros(len(at), np.int64))
        starts, _ = packing.groups(token)
        several = np.minimum.reduceat(doc[order], starts) != np.maximum.reduceat(doc[order], starts)
        order, token = order[several[token]], token[several[token]]
        # equal runs
        kind = token * (int(length.max()) + 1) + length[order]
        by, repeat = repeated_runs(view, at[order], length[order], kind, doc[order])
        gone = order[by[repeat]]
        mark_row, mark_start, mark_length = [row[gone]], [start[gone]], [length[gone]]
        keep = np.sort(by[~repeat])
        order, token = order[keep], token[keep]
        # windows of the other runs, some tokens at a time
        starts, number = packing.groups(token)
        if len(starts):
            apart = np.minimum.reduceat(doc[order], starts) != np.maximum.reduceat(doc[order], starts)
            order, token = order[apart[number]], token[apart[number]]
            before = np.cumsum(count[order]) - count[order]
            starts, number = packing.groups(token)
            block = before[starts][number] // windows if len(starts) else before
            for a in packing.by_bucket(block):
                o = order[a[1]]
                found = list(repeated_windows(view, at[o], count[o], token[a[1]], doc[o], span, windows))
                if found:
                    which, first, last = joined(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
                    mark_row.append(row[o][which])
                    mark_start.append(start[o][which] + first)
                    mark_length.append(last - first - 1 + span)
        rows, begin, n = np.concatenate(mark_row), np.concatenate(mark_start), np.concatenate(mark_length)
        return packing.released(pa.Table.from_batches([packing.blob_batch(_span_rows(n_groups, ids, keys, rows, begin, n))]))

    return fetched.groupBy("bucket").applyInArrow(run, packing.BLOB_SCHEMA)


def _cut(part: pa.RecordBatch, low, high, begin, length) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Bytes of each text, spans of them that go, and the bytes that stay."""
    data, offsets = textops.raw(part.column("text"))
    steps = np.zeros(len(data) + 1, np.int32)
    row = np.repeat(np.arange(part.num_rows), high - low)
    which = np.arange(len(row)) + np.repeat(low - np.r_[0, np.cumsum(high - low)[:-1]], high - low)
    np.add.at(steps, offsets[row] + begin[which], 1)
    np.add.at(steps, offsets[row] + begin[which] + length[which], -1)
    gone = np.cumsum(steps)[:-1] > 0
    owner = np.repeat(np.arange(part.num_rows), np.diff(offsets))
    first = gone & ~np.r_[False, gone[:-1] & (owner[1:] == owner[:-1])] if len(gone) else gone
    last = gone & ~np.r_[gone[1:] & (owner[1:] == owner[:-1]), False] if len(gone) else gone
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    base = offsets[:-1][owner[a]]
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[a], np.arange(part.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(a - base, pa.int32()), pa.array(b - base, pa.int32())], names=["start", "end"]))
    left = np.r_[0, np.cumsum(~gone)][offsets]
    kept = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(left.astype(np.int32).tobytes()), pa.py_buffer(data[~gone].tobytes())])
    return np.diff(offsets), spans, kept


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, bucket_bytes: int = BUCKET_BYTES, row_bytes: int = ROW_BYTES, windows: int = WINDOWS, as_text: bool = False) -> DataFrame:
    """``doc`` (the other columns of the row as a struct), ``is_null`` (the text is), ``n_bytes``, ``removed`` (spans of bytes) and ``kept`` (remaining bytes; ``as_text``: without characters cut in half)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    wide = docs.select(F.struct(*others).alias("doc"), F.col(f"`{text}`").isNull().alias("is_null"), F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    wide = wide.withColumn("key", F.xxhash64("id", "text"))
    texts = wide.select("id", "key", "text")
    n_rows, size = packing.text_size(texts)
    n_buckets, n_groups = packing.bucket_count(size, bucket_bytes), packing.bucket_count(size, row_bytes)
    plan = plan_of(texts, n_rows, size, bucket_bytes, span)
    asked = packing.written(shared_anchors(texts, n_buckets, n_groups, span), "shared-anchors")
    rows = wide.withColumn("group", F.pmod("key", F.lit(n_groups)))
    marks = compare_suffixes(fetch_runs(rows, asked, plan, n_groups, span), n_groups, span, windows)
    schema = packing.extended(rows.select("doc", "is_null"), "n_bytes long, removed array<struct<start:int,end:int>>, kept " + ("string" if as_text else "binary"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, keys, (begin, length) = _spans(right, 2)
        out = []
        for batch in left.combine_chunks().to_batches():
            low, high = _of_rows(ids, keys, _ids(batch.column("id")), batch.column("key").to_numpy())
            n_bytes, spans, kept = _cut(batch, low, high, begin, length)
            if as_text:
                kept = pa.array([x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string())
            out.append(pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("is_null"), pa.array(n_bytes, pa.int64()), spans, kept], names=["doc", "is_null", "n_bytes", "removed", "kept"]))
        if not out:
            from pyspark.sql.pandas.types import to_arrow_schema

            return to_arrow_schema(schema).empty_table()
        return packing.released(pa.Table.from_batches(out))

    return rows.groupBy("group").cogroup(marks.groupBy("bucket")).applyInArrow(finish, schema)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with repeated spans cut out of the text; characters cut in half are dropped, documents left without text go."""
    done = remove_repeats(docs, doc_id, text, as_text=True, **options).where("kept <> '' OR n_bytes = 0")
    return done.select(*[(F.when(F.col("is_null"), None).otherwise(F.col("kept")) if c == text else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
