"""Copies of one vector: ties go to the smaller id; very large and small components; many blocks."""

import numpy as np
from pyspark.sql import functions as F

from astrolake.llm import ann_search


def test_copies_of_one_vector():
    for turn in range(40):
        rng = np.random.default_rng(turn)
        base, one = rng.normal(size=(903, 64)), rng.normal(size=64)
        vectors = np.concatenate([base, one * 2.0 ** rng.integers(-3, 4, (50, 1))])
        dealt = rng.permutation(len(vectors))
        ids = rng.permutation(len(vectors)).astype(np.int64)
        near = one + rng.normal(size=64) * 0.1
        _, c, s = ann_search.search(ann_search.Block(ids, vectors[dealt]), np.array([-1, -2]), np.stack([near, one]), 5)
        assert ids[c].tolist() == sorted(ids[dealt >= 903].tolist())[:5] * 2
        assert len(set(s[:5])) == len(set(s[5:])) == 1


def test_the_stopping_test_ends_the_search():
    """Clustered vectors: most points are never verified, and nearly all neighbours are found."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    v = (centres[:, None] + 0.3 * rng.normal(size=(40, 100, 64))).reshape(-1, 64)
    ids, asked, shares = np.arange(len(v)), np.arange(0, len(v), 97), []
    q, c, _ = ann_search.search(ann_search.Block(ids, v), asked, v[asked], 5, tally=shares)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -9
    best = np.argsort(-s, axis=1)[:, :5]
    hits = np.mean([len(set(best[i]) & set(c[q == i])) / 5 for i in range(len(asked))])
    assert np.mean(shares) < 0.25 and hits >= 0.9


def test_a_thousand_copies():
    """The smallest ids win, whatever leaves the copies fall into."""
    rng = np.random.default_rng(6)
    one = rng.normal(size=64)
    vectors = np.concatenate([np.repeat(one[None], 1000, axis=0), rng.normal(size=(500, 64))])
    dealt = rng.permutation(len(vectors))
    ids = np.empty(len(vectors), np.int64)
    ids[dealt] = np.arange(len(vectors))
    copies = sorted(ids[:1000].tolist())
    _, c, _ = ann_search.search(ann_search.Block(ids, vectors), np.array(copies[:1]), one[None], 5)
    assert ids[c].tolist() == copies[1:6]


def test_extreme_components_and_clashing_names(spark):
    """Squares that a double does not hold change nothing, and other columns do not matter."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(120, 8))
    scale = np.array([1e200, 1e-200, 1.0, 1e150])[np.arange(120) % 4]
    rows = [(i, (v * s).tolist(), 1, "x", 2.0) for i, (v, s) in enumerate(zip(base, scale, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int, id string, score double").repartition(3)
    got = ann_search.neighbours(df, F.col("id") % 50 == 0, k=5, confidence=0.999999).collect()
    u = base / np.linalg.norm(base, axis=1)[:, None]
    for q in (0, 50, 100):
        s = u @ u[q]
        s[q] = -9
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == np.argsort(-s, kind="stable")[:5].tolist()
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in mine)


def test_recall_over_several_blocks(spark):
    """Vectors are moved once however many chunks of queries there are."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 32))
    v = (centres[:, None] + 0.4 * rng.normal(size=(30, 100, 32))).reshape(-1, 32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    found = ann_search.neighbours(df, F.col("id") % 50 == 0, k=5, block=400, chunk=3)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hits, got = 0, found.collect()
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 300 and hits / 300 >= 0.9
