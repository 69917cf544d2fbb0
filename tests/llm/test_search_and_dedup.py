"""Joins, dedup, decontamination and search against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolake.llm import ann_search, decontaminate, jaccard_join, packing, suffix_dedup, textops

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def low(text):
    return (text or "").encode().translate(LOWER)


def shingles(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)].append(r[0])
    return sorted(((r[0], len(s), min(least[root(i)]) if least[root(i)] else None) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("options", [{}, {"bucket_tokens": 500, "frequent": 2, "all_pairs": 2}, {"frequent": 2, "max_frequent": 3, "all_pairs": 3}])
def test_jaccard_components(docs, rows, options):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, **options).collect()), key=repr)
    assert got == brute_components(rows)


def test_jaccard_boundary(spark):
    """Exactly 75 of 100 links; one less does not."""
    words = [f"a{i}" for i in range(7 + 4)]
    same = " ".join(words)
    rows = [(1, same), (2, " ".join([*words, "b"])), (3, " ".join([*words, "b", "c"])), (4, " ".join([*words, "b", "c", "d"]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {r[0]: r[2] for r in brute_components(rows)}


def test_jaccard_empty_and_keep_one(docs, nothing, rows):
    assert jaccard_join.jaccard_components(nothing).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted((i for i, _, c in brute_components(rows) if i is None or i == c), key=repr)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == want


def brute_removed(rows, span=50):
    first = {}
    key = lambda i: np.inf if i is None else i
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - span + 1):
            s = b[p : p + span]
            first[s] = min(first.get(s, np.inf), key(i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if first[b[p : p + span]] < key(i):
                gone[p : p + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 3000, "row_bytes": 2000}, {"windows": 100}])
def test_suffix_dedup(docs, rows, options):
    found = suffix_dedup.remove_repeats(docs.select("doc_id", "text"), **options).collect()
    got = sorted(((r["doc"]["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found), key=repr)
    assert got == brute_removed(rows)


def test_suffix_dedup_small_flushes(docs, rows, monkeypatch):
    monkeypatch.setattr(packing, "FLUSH_BYTES", 2000)
    found = suffix_dedup.remove_repeats(docs.select("doc_id", "text"), bucket_bytes=5000).collect()
    assert sorted(((r["doc"]["doc_id"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found), key=repr) == sorted(((r[0], r[4]) for r in brute_removed(rows)), key=repr)


@pytest.mark.parametrize("hot", [1, 2])
def test_suffix_dedup_hot_tokens(docs, rows, monkeypatch, hot):
    """Tokens that are dealt window by window give the same result, also where ranges are parted by token."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "MAX_RANGES", 5)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1 << 20)
    found = suffix_dedup.remove_repeats(docs.select("doc_id", "text"), bucket_bytes=4000).collect()
    assert sorted(((r["doc"]["doc_id"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found), key=repr) == sorted(((r[0], r[4]) for r in brute_removed(rows)), key=repr)


@pytest.mark.parametrize("unit", ["<> *** ~~~ ", "-=-", "ab "])
@pytest.mark.parametrize("hot", [1, 2, None])
def test_suffix_dedup_hot_tokens_of_periods(spark, monkeypatch, unit, hot):
    """Windows in which a hot token stands several times meet wherever their runs begin."""
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(len(unit))
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(20, 60)))
    rows = []
    for i in range(120):
        a, n = rng.randrange(len(unit)), rng.randrange(55, 110)
        rows.append((i, letters() + (unit * 60)[a : a + n] + letters()))
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted(((r["doc"]["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found), key=repr)
    assert got == brute_removed(rows)


def test_suffix_dedup_compares_bytes(spark, monkeypatch):
    """Nothing unique goes, however badly tokens are hashed for the first exchange."""
    monkeypatch.setattr(suffix_dedup, "_CUT", np.uint64(61))
    thue = lambda n: [bin(i).count("1") & 1 for i in range(n)]
    a, b = ("".join("ab"[x] for x in t) for t in (thue(1024), [1 - x for x in thue(1024)]))
    rng = np.random.default_rng(3)
    token = "one token of all"
    texts = [a, b] + [token + "".join(chr(97 + x) for x in rng.integers(0, 26, 34)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc"]["doc_id"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found)) == [(r[0], r[4]) for r in sorted(brute_removed(rows))]


def test_multikey_order():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    at, length = rng.integers(0, 3900, 700), np.full(700, 50)
    group = rng.integers(0, 3, 700)
    order, same = suffix_dedup.multikey_order(textops.eights(data, ">"), at, length, group)
    strings = [(int(group[i]), data[at[i] : at[i] + 50].tobytes()) for i in order]
    assert strings == sorted(strings)
    assert [bool(x) for x in np.diff(same)] == [x != y for x, y in zip(strings[1:], strings[:-1], strict=True)]


def test_suffix_stage_keeps_columns(docs, nothing):
    out = suffix_dedup.deduplicate(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    assert out.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert suffix_dedup.deduplicate(nothing).count() == 0


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def brute_hits(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[k]
        out.append((r[0], len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, rows, nothing, group_bytes):
    source = [r[1] for r in rows if r[1] and len(words(r[1])) >= 60]
    items = [(1, " ".join(source[0].split()[5:20])), (2, "ONE, two"), (3, None), (4, ""), (10, source[1].replace(" ", " - ")[:200]), (11, source[1][:200]), (5, "ab " * 30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc"]["doc_id"], r["n_words"], r["hit_words"], tuple(r["items"])) for r in decontaminate.contaminated_words(docs.select("doc_id", "text"), bench, group_bytes=group_bytes).collect()), key=repr)
    assert got == brute_hits(rows, items)
    kept = decontaminate.decontaminate(docs, bench, group_bytes=group_bytes)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in got if not r[2])
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_winnow_guarantee():
    rng = np.random.default_rng(0)
    a, b, shared = (rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (50, 60, 10))
    for text in (np.r_[a, shared, b], np.r_[b, shared, a]):
        grams = textops.gram_hashes(text, 5)
        kept = set(grams[decontaminate.winnow(grams, 6)].tolist())
        assert kept & set(textops.gram_hashes(shared, 5).tolist())


def test_words_match_regular_expressions(rows):
    import pyarrow as pa

    data, offsets = textops.raw(pa.array([r[1] for r in rows]))
    for mask, pattern in ((textops.BLANK_WORD, rb"[^\x20\x09-\x0D]+"), (textops.ALNUM_WORD, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = textops.Words(data, offsets, mask)
        got = [[w.data[a:b].tobytes() for a, b in zip(w.start[x:y], w.end[x:y], strict=True)] for x, y in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
        assert got == [re.findall(pattern, low(r[1])) for r in rows]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 16))
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)]
    rows += [(1000, None), (1050, []), (1100, [0.0] * 16), (1150, [float("nan")] + [1.0] * 15), (1200, [None] + [1.0] * 15), (1250, [1.0, 0.0]), (1300, [2.0, 0.0]), (50, rows[50][1]), (701, rows[3][1])]
    got = ann_search.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, k=5, block=200, chunk=5).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(by) == {*range(0, 700, 50), 1250, 1300} and by[1250] == [(1300, 1.0)]
    ids = np.array([*range(700), 701])
    m = np.vstack([v, v[3]])
    u = m / np.linalg.norm(m, axis=1)[:, None]
    hits = 0
    for q in range(0, 700, 50):
        s = u @ u[q]
        s[q] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        hits += len(set(best) & {i for i, _ in by[q]})
        assert all(abs(x - s[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, x in by[q])
    assert hits >= 0.9 * 70
    none = ann_search.neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("id") % 50 == 0)
    assert none.count() == 0
