"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into lower-cased words.  A *window* is
``span`` consecutive words of an item, or the whole item when it has fewer.
A document word is hit when it lies inside an occurrence of a window.

Winnowing keeps, of every ``span - k + 1`` consecutive k-word hashes, the
smallest (the rightmost of equals).  Any shared run of ``span`` words holds the
same k-word hashes on both sides and so the same kept one: joining kept
fingerprints of documents and items finds every shared window.  Each hit is
then extended word by word in both directions, and counts if the shared run
reaches ``span`` words.  Items shorter than ``span`` words are looked up by
their whole-item hash, as their own length says.

A benchmark of at most ``group_bytes`` of text is broadcast as an index of its
fingerprints and words; documents are winnowed and joined with it in one pass and never
shuffled.  A larger one is joined by a shuffle: fingerprints of both sides meet by their
hash, the pairs of document and item that share one are made distinct, and each pair is
extended on its own texts; only such documents' texts are moved.

Defined cases: null and empty texts have no words and are not contaminated;
items without words occur nowhere; repeated rows are each judged alike; a null
item id is listed as the empty string; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.llm import packing, textops

SPAN, K = 10, 5
#: A benchmark of at most so many bytes of text is broadcast.
GROUP_BYTES = 16 << 20

HITS = ("n_words", "hit_words", "items", "spans")
_HITS = "n_words long, hit_words long, items array<string>, spans array<struct<start:int,end:int>>"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions kept: the rightmost minimum of every ``width`` consecutive hashes."""
    n = len(grams)
    if n == 0:
        return np.zeros(0, np.int64)
    width = min(width, n)
    windows = np.lib.stride_tricks.sliding_window_view(grams[::-1], width)
    at = np.argmin(windows, axis=1) + np.arange(len(windows))
    return np.unique(n - 1 - at)


def winnowed(grams: np.ndarray, bounds: np.ndarray, span: int, k: int) -> np.ndarray:
    """Positions kept in all rows of a slice that have ``span`` words or more; ``bounds`` of their words."""
    n = int(bounds[-1]) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, best = np.zeros(n, np.int8), grams[:n].copy()
    for j in range(1, span - k + 1):
        now = grams[j : j + n]
        less = now <= best
        at[less] = j
        np.minimum(best, now, out=best)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    first = np.arange(n)
    return np.unique((first + at)[first + span <= bounds[row + 1]])


class Index:
    """Fingerprints of one group of items, and the items' word hashes to extend hits with."""

    def __init__(self, items: list[tuple[str, str]], span: int = SPAN, k: int = K):
        self.span, self.k = span, k
        self.ids: list[str] = []
        self.words: list[np.ndarray] = []
        self.short: dict[int, dict[int, list[int]]] = {}
        prints, owner, where = [], [], []
        for item_id, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            h = textops.Words(data, np.array([0, len(data)]), textops.ALNUM_WORD).hashes()
            if not len(h):
                continue
            i = len(self.ids)
            self.ids.append(item_id)
            self.words.append(h)
            if len(h) < span:
                whole = int(textops.gram_hashes(h, len(h))[0])
                self.short.setdefault(len(h), {}).setdefault(whole, []).append(i)
                continue
            grams = textops.gram_hashes(h, k)
            kept = winnow(grams, span - k + 1)
            prints.append(grams[kept])
            owner.append(np.full(len(kept), i))
            where.append(kept)
        p = np.concatenate([np.zeros(0, np.uint64), *prints])
        order = np.argsort(p, kind="stable")
        self.prints = p[order]
        self.owner = np.concatenate([np.zeros(0, np.int64), *owner]).astype(np.int64)[order]
        self.where = np.concatenate([np.zeros(0, np.int64), *where]).astype(np.int64)[order]
        self.lengths = {n: np.sort(np.array(list(found), np.uint64)) for n, found in self.short.items()}

    def search(self, words: textops.Words) -> dict[int, list[tuple[int, int, int]]]:
        """Per row of the slice with hits: (first word, end, item) of maximal shared runs, words counted in the row."""
        hashes, found = words.hashes(), {}
        bounds = words.bounds

        def add(row: int, a: int, b: int, item: int) -> None:
            found.setdefault(row, []).append((a - int(bounds[row]), b - int(bounds[row]), item))

        grams = textops.gram_hashes(hashes, self.k)
        if len(self.prints) and len(grams):
            # fingerprints of the rows that are fingerprints of items as well
            at = winnowed(grams, bounds, self.span, self.k)
            slot = np.searchsorted(self.prints, grams[at])
            slot[slot == len(self.prints)] = 0
            hit = self.prints[slot] == grams[at]
            at, slot = at[hit], slot[hit]
            rows = np.searchsorted(bounds, at, "right") - 1
            done: dict[tuple[int, int], int] = {}
            for p, row, s in zip(at.tolist(), rows.tolist(), slot.tolist(), strict=True):
                low, high = int(bounds[row]), int(bounds[row + 1])
                if p + self.k > high:
                    continue
                while s < len(self.prints) and self.prints[s] == grams[p]:
                    item, q = int(self.owner[s]), int(self.where[s])
                    s += 1
                    if done.get((item, p - q), -1) > p:
                        continue
                    w = self.words[item]
                    a = b = 0
                    while p - a > low and q - a > 0 and hashes[p - a - 1] == w[q - a - 1]:
                        a += 1
                    while p + b < high and q + b < len(w) and hashes[p + b] == w[q + b]:
                        b += 1
                    done[item, p - q] = p + b
                    if a + b >= self.span:
                        add(row, p - a, p + b, item)
        for n, wanted in self.lengths.items():
            grams = textops.gram_hashes(hashes, n)
            slot = np.searchsorted(wanted, grams)
            slot[slot == len(wanted)] = 0
            at = np.flatnonzero(wanted[slot] == grams) if len(grams) else np.zeros(0, np.int64)
            for p, row in zip(at.tolist(), (np.searchsorted(bounds, at, "right") - 1).tolist(), strict=True):
                if p + n <= bounds[row + 1]:
                    for item in self.short[n][int(grams[p])]:
                        add(row, p, p + n, item)
        return found


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlaps merged."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _mark(rows: DataFrame, index: Index) -> DataFrame:
    """(doc, n_words, hit_words, items, spans) from (doc, text), by a broadcast index."""
    held = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for batch in batches:
            for part in textops.pieces(batch, "text"):
                words = textops.Words(*textops.raw(part.column("text")), textops.ALNUM_WORD)
                found = ix.search(words)
                items, spans, hit = [], [], []
                for row in range(part.num_rows):
                    runs = found.get(row, ())
                    merged = united([r[:2] for r in runs])
                    items.append(sorted({ix.ids[r[2]] for r in runs}))
                    spans.append([{"start": a, "end": b} for a, b in merged])
                    hit.append(sum(b - a for a, b in merged))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(np.diff(words.bounds), pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)], names=["doc", *HITS])

    return rows.select("doc", "text").mapInArrow(run, packing.extended(rows.select("doc"), _HITS))


def _joined(rows: DataFrame, items: DataFrame, span: int, k: int) -> DataFrame:
    """The same by a shuffle join of fingerprints, for a benchmark of any size."""
    texts = rows.select(F.coalesce("text", F.lit("")).alias("t")).select(F.xxhash64("t").alias("key"), F.xxhash64(F.lit(1), "t").alias("key2"), "t")

    def prints_of(words: textops.Words, lengths: set[int], keep_whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and fingerprints; items below ``span`` words, and all runs of documents as long, by their whole hash."""
        hashes, bounds = words.hashes(), words.bounds
        grams = textops.gram_hashes(hashes, k)
        at = winnowed(grams, bounds, span, k)
        yield np.searchsorted(bounds, at, "right") - 1, grams[at]
        for n in lengths:
            whole = textops.gram_hashes(hashes, n)
            at = bounds[:-1][np.diff(bounds) == n] if keep_whole else np.arange(len(whole))
            row = np.searchsorted(bounds, at, "right") - 1
            inside = at + n <= bounds[row + 1]
            yield row[inside], textops.mix(whole[at[inside]] + np.uint64(n))

    def fingerprints(df: DataFrame, names: list[str], lengths: set[int], keep_whole: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                for part in textops.pieces(batch, "t"):
                    found = list(prints_of(textops.Words(*textops.raw(part.column("t")), textops.ALNUM_WORD), lengths, keep_whole))
                    row, value = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), *(part.column(c).take(pa.array(row)) for c in names)], names=["print", *names])

        return df.mapInArrow(run, ", ".join(f"{c} long" for c in ["print", *names])).distinct()

    def lengths_of(batches):
        for batch in batches:
            n = {int(x) for part in textops.pieces(batch, "t") for x in np.diff(textops.Words(*textops.raw(part.column("t")), textops.ALNUM_WORD).bounds)}
            yield pa.RecordBatch.from_arrays([pa.array([x for x in n if 0 < x < span], pa.int32())], names=["n"])

    short = {r["n"] for r in items.select("t").mapInArrow(lengths_of, "n int").distinct().collect()}
    pairs = fingerprints(texts, ["key", "key2"], short, False).join(fingerprints(items.select("t", "item"), ["item"], short, True), "print").select("key", "key2", "item").distinct()
    pairs = packing.written(pairs, "fingerprint-pairs")
    wide = texts.dropDuplicates(["key", "key2"]).join(pairs, ["key", "key2"]).join(items.select("item", "id", F.col("t").alias("item_text")), "item").select("key", "key2", "t", "id", "item_text")

    def extend(batches):
        for batch in batches:
            spans = []
            for i, (name, said) in enumerate(zip(batch.column("id").to_pylist(), batch.column("item_text").to_pylist(), strict=True)):
                found = Index([(name, said)], span, k).search(textops.Words(*textops.raw(batch.column("t").slice(i, 1)), textops.ALNUM_WORD))
                spans.append([{"start": a, "end": b} for a, b in united([r[:2] for r in found.get(0, ())])])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "key2", "id")), pa.array(spans, _SPANS)], names=["key", "key2", "id", "spans"])

    hits = wide.mapInArrow(extend, "key long, key2 long, id string, spans array<struct<start:int,end:int>>").where(F.size("spans") > 0)
    hits = hits.groupBy("key", "key2").agg(F.array_sort(F.collect_set("id")).alias("items"), _union_spans(F.flatten(F.collect_list("spans"))).alias("spans"))
    hits = hits.withColumn("hit_words", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"]))
    said = F.coalesce(F.col("text"), F.lit(""))
    keyed = rows.withColumn("k1", F.xxhash64(said)).withColumn("k2", F.xxhash64(F.lit(1), said))
    n_words = F.regexp_count(F.translate(said, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_WORD)).cast("long")
    done = keyed.join(hits, (F.col("k1") == F.col("key")) & (F.col("k2") == F.col("key2")), "left")
    none = F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return done.select("doc", n_words.alias("n_words"), F.coalesce("hit_words", F.lit(0)).cast("long").alias("hit_words"), F.coalesce("items", none[0]).alias("items"), F.coalesce("spans", none[1]).alias("spans"))


def contaminated_words(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``doc`` (the row of ``docs`` as a struct), ``n_words``, ``hit_words``, ``items`` (ids as strings, sorted) and ``spans`` (hit words)."""
    rows = packing.wrapped(docs, text=text)
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("t")).distinct().withColumn("item", F.xxhash64("id", "t"))
    _, size = packing.text_size(items, "t")
    if size > group_bytes:
        return _joined(rows, items, span, k)
    return _mark(rows, Index([(r["id"], r["t"]) for r in items.select("id", "t").orderBy("id", "t").collect()], span, k))


def _union_spans(spans):
    """Merge an array of spans, in SQL functions."""
    kind = "array<struct<start:int,end:int>>"
    start = F.expr(f"cast(array() as {kind})")

    def step(done, s):
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), start, step).cast(kind)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without a hit, with all their columns."""
    return contaminated_words(docs, benchmark, text, **options).where("hit_words = 0").select("doc.*")
