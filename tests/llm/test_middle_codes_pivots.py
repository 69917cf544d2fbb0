"""Fill-in-the-middle forms, vector codes and exact product search against plain Python."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolake.llm import fill_middle, pivot_search, queries, vector_codes

DATA = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def arranged(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\t ", "word", " word ", "a<P>b", "x<", "<", "S>", "<P", "é 𝔘𝔫   ß x", "a\u0085b c", "tail   \n\n", "ab " * 200000, "x" * 300000, "\x00 a\x00b"]
    texts += ["".join(rng.choice(["<", ">", "P", "S", "M", " ", "\n", "wörd", "𝔘"]) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    rows = [(i, t, "d", "u", 1) for i, t in enumerate(texts)] + [(3, texts[3], "d", "u", 1)] * 2 + [(None, "no id at all here", None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, units string, n int").repartition(3)
    made = fill_middle.transformed(docs)
    assert "Exchange" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = made.select("doc.doc_id", "doc.text", "doc.units", "form", "n", F.char_length("prefix").alias("p"), F.char_length("middle").alias("m"), "output", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["p"], r["m"], r["output"]) == arranged(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert fill_middle.transformed(docs.where("false")).count() == 0


def test_fill_middle_shares_and_sentinels(spark):
    docs = spark.range(4000).select(F.col("id").alias("k"), F.concat_ws(" ", *[F.lit("w")] * 9).alias("body"))
    made = fill_middle.transformed(docs, "k", "body", seed=7, moved=90, suffix_first=30, sentinels=("[[a]]", "[[b]]", "[[c]]"))
    count = {r["form"]: r["count"] for r in made.groupBy("form").count().collect()}
    assert abs(count["plain"] - 400) < 100 and abs(count["spm"] - 1080) < 150
    assert made.where(fill_middle.restored(F.col("output"), F.col("form"), ("[[a]]", "[[b]]", "[[c]]")) != F.col("doc.body")).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("", "b", "c"), ("aa", "b", "c"), ("xay", "a", "c")):
        with pytest.raises(ValueError):
            fill_middle.checked(bad)


INF, NAN = float("inf"), float("nan")


def vector_rows(rng, dim=16):
    """Vectors with copies, ties, nulls, non-finite components, other dimensions, repeated ids and rows."""
    base = [[rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) for _ in range(dim)] for _ in range(40)]
    rows = [(100 + i, rng.choice(base) if i % 3 else [rng.uniform(-1, 1) for _ in range(dim)], i % 4 if i % 7 else None) for i in range(220)]
    rows += [(1, None, 1), (2, [NAN] + [0.0] * (dim - 1), 1), (3, [None] + [0.0] * (dim - 1), 2), (4, [INF] + [0.0] * (dim - 1), 2), (5, [-INF] + [0.0] * (dim - 1), 2), (6, [1e200] + [0.0] * (dim - 1), 2)]
    rows += [(140, [rng.uniform(-1, 1) for _ in range(dim)], 2), rows[12], rows[12], (20, [0.0] * dim, 0), (None, base[0], 3)]
    rows += [(300 + i, [rng.uniform(-1, 1) for _ in range(5)], 9) for i in range(7)] + [(400, [], 9), (420, [1.0], 9), (421, [-1.0], 9)]
    rng.shuffle(rows)
    return [(i, v, label, "x", 0) for i, v, label in rows]


def usable(v, most):
    return v is not None and all(x is not None and abs(x) < INF and abs(x) <= most / max(len(v), 1) ** 0.5 for x in v)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """By dimension: codes and errors of the rows (id, v), and the books, by loops."""
    out = {}
    for dim in {len(v) for _, v, *_ in rows if usable(v, 2.0**18)}:
        kept = [(i, [int(np.floor(4096 * x)) for x in v]) for i, v, *_ in rows if usable(v, 2.0**18) and len(v) == dim]
        first = {}
        for i, v in kept:
            if i is not None:
                first[i] = min(first.get(i, v), v)
        at = [p * dim // parts for p in range(parts + 1)]
        books = [[first[i][a:b] for i in sorted(first)[:entries]] for a, b in zip(at[:-1], at[1:], strict=True)]

        def nearest(v, at=at):
            found = []
            for p, book in enumerate(books):  # noqa: B023
                part = v[at[p] : at[p + 1]]
                found.append(min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(book)))
            return found

        for _ in range(rounds):
            found, after = [nearest(v) for _, v in kept], []
            for p, book in enumerate(books):
                after.append([])
                for k, e in enumerate(book):
                    mine = [v[at[p] : at[p + 1]] for (_, v), f in zip(kept, found, strict=True) if f[p][1] == k]
                    after[-1].append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else e)
            books = after
        out[dim] = (sorted(((i if i is not None else -1), [k for _, k in f], sum(d for d, _ in f)) for (i, v) in kept for f in [nearest(v)]), books)
    return out


KINDS = "id long, v array<double>, label int, doc string, error int"


@pytest.mark.parametrize("parts", [1, 5])
def test_vector_codes(spark, parts):
    rows = vector_rows(random.Random(5))
    df = spark.createDataFrame(rows, KINDS).repartition(parts)
    books = vector_codes.train(df, "id", "v")
    got = vector_codes.encoded(df, books, "id", "v").select("doc.id", F.size("doc.v").alias("dim"), "code", "error").collect()
    want = plain_codes(rows)
    assert set(books) == set(want) == {0, 1, 5, 16}
    for dim, (codes, plain) in want.items():
        assert [b.tolist() for b in books[dim]] == plain
        assert sorted(((r["id"] if r["id"] is not None else -1), list(r["code"]), r["error"]) for r in got if r["dim"] == dim) == codes
    v = np.array(next(x for _, x, *_ in rows if usable(x, 2.0**18) and len(x) == 16))
    one = vector_codes.encoded(spark.createDataFrame([(1, v.tolist())], "id long, v array<double>"), books, "id", "v").first()
    assert ((vector_codes.decoded(one["code"], books[16]) - np.floor(4096 * v)) ** 2).sum() == one["error"]


def test_vector_codes_few_and_none(spark):
    few = spark.createDataFrame([(7, [0.1] * 8), (3, [0.2] * 8), (9, None)], "vec_id long, embedding array<float>")
    books = vector_codes.train(few)
    assert [len(b) for b in books[8]] == [2] * 8
    assert [r["code"] for r in vector_codes.encoded(few, books).orderBy("doc.vec_id").select("code").collect()] == [[0] * 8, [1] * 8]
    assert vector_codes.train(few.where("false")) == {} and vector_codes.encoded(few.where("false"), {}).count() == 0
    assert vector_codes.encoded(few, {}).count() == 0


@pytest.mark.parametrize("leaf", [1, 2, 5, 100])
def test_tree_ties(leaf):
    rng = np.random.default_rng(leaf)
    for n in (1, 2, 16, 33):
        entries, points = rng.integers(-2, 3, (n, 3)), rng.integers(-3, 4, (400, 3))
        index, best = vector_codes.KdTree(entries, leaf).nearest(points)
        d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


@pytest.mark.parametrize("most", [0, 1 << 16])
def test_group_errors(spark, most):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3, i) for i in range(30)], "k int, label int, error long")
    got = {r["k"]: r["label_error"] for r in vector_codes.with_group_error(rows, "label", most=most).collect()}
    assert got == {i: sum(j for j in range(30) if j % 3 == i % 3) for i in range(30)}


def plain_products(rows, k, every):
    kept = {}
    for i, v, *_ in rows:
        if i is not None and usable(v, 2.0**25):
            v = [int(np.floor(64 * x)) for x in v]
            kept[i, len(v)] = min(kept.get((i, len(v)), v), v)
    out = set()
    for (q, dim), v in kept.items():
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for (c, d), w in kept.items() if d == dim and c != q)[:k]
            out |= {(q, dim, r + 1, c, -s) for r, (s, c) in enumerate(found)}
    return out


@pytest.mark.parametrize("block,chunk,k", [(None, 64, 20), (30, 2, 20), (7, 3, 3), (30, 64, 500)])
def test_pivot_search(spark, block, chunk, k):
    rows = vector_rows(random.Random(6))
    rows += [(1000 + i, [0.5] * 16, 0, "", 0) for i in range(60)] + [(2000 + i, [30000.0 * ((i % 5) - 2)] + [1.0] * 15, 0, "", 0) for i in range(20)]
    got = pivot_search.largest_products(spark.createDataFrame(rows, KINDS).repartition(4), F.col("id") % 20 == 0, k, "id", "v", block=block, chunk=chunk).collect()
    assert {tuple(r) for r in got} == plain_products(rows, k, 20) and len(got) == len({tuple(r) for r in got})


def test_pivot_search_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivot_search.largest_products(empty, F.col("id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert pivot_search.largest_products(alone, F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("most,kind", [(1, np.float32), (3000, np.float64), (1 << 22, np.int64)])
def test_bounds_hold_and_stop(most, kind):
    rng = np.random.default_rng(8)
    centres = rng.integers(-40 * most, 40 * most, (12, 8))
    vectors = centres[rng.integers(0, 12, 3000)] + rng.integers(-most, most + 1, (3000, 8))
    chosen, table = pivot_search.pivot_table(vectors, 24)
    block = pivot_search.Block(np.arange(3000), vectors, chosen, table)
    assert pivot_search.exact_kind(block.longest) == kind
    for q in range(0, 3000, 100):
        exact = [int(a) for a in (vectors.astype(object) @ vectors[q].astype(object))]
        bound = block.bounds(vectors[q], float((vectors[q].astype(float) ** 2).sum()))
        assert (bound >= np.array(exact, float) * (1 - 1e-12)).all()
        rows, score = block.best(q, vectors[q], 10, pivot_search.NONE)
        assert [(int(s), int(r)) for r, s in zip(rows, score, strict=True)] == [(s, i) for s, i in sorted(((s, i) for i, s in enumerate(exact) if i != q), key=lambda x: (-x[0], x[1]))[:10]]
    assert block.evaluated < 0.5 * block.asked


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_vector_codes", "op13_pivot_search"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cursor = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    want = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got and got == want
