"""Every word has a probability of its own, and the vocabulary follows the corpus."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from astrolake.llm import pseudo_likelihood, textops


def test_rare_words_differ_by_spelling(spark):
    rng = random.Random(8)
    known = [f"v{i}" for i in range(1000)]
    texts = [" ".join(f"{rng.choice(known)} tion{''.join(rng.choice('aeinst') for _ in range(7))}" for _ in range(400)) for _ in range(80)]
    docs = [*enumerate(texts), (900, "v1 v2 tionaeinsta v3 v4"), (901, "v1 v2 zq7xk0jw9pf v3 v4")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    ranked, counts, rest = pseudo_likelihood.full_vocabulary(frame.select(F.col("text").alias("t")), 3)
    assert len(ranked) > pseudo_likelihood.WORDS and rest > 0 and counts.min() >= pseudo_likelihood.least_count(64010)
    found = {r["doc_id"]: r["score"] for r in pseudo_likelihood.scored(frame).collect()}
    # the same surroundings: only the spelling of the rare word in the middle tells them apart by much
    assert found[900] > found[901] + 5


def test_spelling_sums_to_one(spark):
    texts = spark.createDataFrame([("abc ab a9 été b",)], "t string")
    table = pseudo_likelihood.spelling(texts, np.zeros(0, np.uint64))
    sums = np.where(table < 0, np.exp(table), 0).sum(axis=1)
    may = np.r_[textops.ALNUM_WORD, True]
    assert np.allclose(sums[may], 1) and not sums[~may].any()
    words = textops.Words(*textops.raw(pa.array(["Ab a", None, "é"])), textops.ALNUM_WORD)
    chains = [[256, 97, 98, 256], [256, 97, 256], [256, 0xC3, 0xA9, 256]]
    assert np.allclose(pseudo_likelihood.spelled(words, table), [sum(table[x, y] for x, y in zip(c, c[1:])) for c in chains])


def test_words_sum_to_one():
    net, rng = pseudo_likelihood.Network(None, *pseudo_likelihood.shape_for(900)), np.random.default_rng(1)
    net.start_from(rng.integers(1, 50, 900), 77)
    per, last = net.per_class, (net.classes - 1) * net.per_class
    target = np.arange(last + 1)
    p = net.log_probabilities(np.repeat(rng.integers(0, last, (4, 1)), len(target), axis=1), target, np.zeros(len(target)))
    assert per * per > 900 and last >= 900 and abs(np.exp(p).sum() - 1) < 1e-3


def test_natural_order_beats_shuffled_and_gibberish(spark):
    """Sentences of a small grammar score above the same words shuffled, and these above random letters."""
    rng = random.Random(11)
    parts = [[f"{kind}{i}" for i in range(40)] for kind in ("the", "adj", "noun", "verb", "adv")]
    natural = [" ".join(rng.choice(p) for _ in range(80) for p in parts) for _ in range(120)]
    shuffled = [" ".join(rng.sample(t.split(), 400)) for t in natural[:20]]
    noise = [" ".join("".join(rng.choice("qwxzkjvb") for _ in range(rng.randrange(3, 9))) for _ in range(400)) for _ in range(20)]
    docs = [(i, t) for i, t in enumerate([*natural, *shuffled, *noise])]
    found = {r["doc_id"]: r["mean_score"] for r in pseudo_likelihood.scored(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), rounds=6).collect()}
    means = [np.mean([found[i] for i in range(*ab)]) for ab in ((0, 120), (120, 140), (140, 160))]
    assert means[0] > means[1] + 0.2 and means[1] > means[2] + 1


def prose(rng, n, kinds=("det", "adj", "noun", "verb", "adv"), words=300):
    """Sentences of a grammar of ``words`` words a kind, frequent ones first."""
    return " ".join(f"{k}{min(int(rng.expovariate(0.02)), words - 1)}" for _ in range(n) for k in kinds)


def test_default_parameters_use_the_surroundings(spark):
    """With the default rounds and several partitions natural order is worth 0.2 nats a token and more."""
    rng = random.Random(12)
    natural = [prose(rng, rng.randrange(10, 120)) for _ in range(400)]
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in natural[:60]]
    frame = spark.createDataFrame([*enumerate([*natural, *shuffled])], "doc_id long, text string").repartition(6)
    found = {r["doc_id"]: r["mean_score"] for r in pseudo_likelihood.scored(frame).collect()}
    gaps = [found[i] - found[400 + i] for i in range(60)]
    assert np.mean(gaps) > 0.2 and np.mean([g > 0 for g in gaps]) > 0.95


def test_very_long_text_and_clashing_names(spark):
    rng = random.Random(13)
    long = prose(rng, 20000)
    rows = [(1, long, "x", 1.0, 2, "h"), (2, prose(rng, 30), "x", 1.0, 2, "h"), (3, None, "x", 1.0, 2, "h"), (2**62, "short", None, None, None, None)]
    got = {r["doc_id"]: r for r in pseudo_likelihood.scored(spark.createDataFrame(rows, "doc_id long, text string, t string, score double, n_tokens int, h string")).collect()}
    assert got[1]["n_tokens"] == 100000 and got[3]["score"] == 0 and got[2**62]["n_tokens"] == 1
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got.values())


def test_words_beyond_the_bound_are_spelled(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "MOST_WORDS", 40)
    rng = random.Random(14)
    frame = spark.createDataFrame([(i, prose(rng, 40)) for i in range(30)], "doc_id long, text string")
    ranked, counts, rest = pseudo_likelihood.full_vocabulary(frame.select(F.col("text").alias("t")), 3)
    assert len(ranked) == 40 and int(counts.sum()) + rest == 30 * 200 and (np.diff(counts) <= 0).all()
    assert all(np.isfinite(r["score"]) for r in pseudo_likelihood.scored(frame).collect())


def test_steps_follow_the_gradient():
    """The first step of every row goes down its gradient, by the same length."""
    rng = np.random.default_rng(3)
    net = pseudo_likelihood.Network(None)
    around, target = rng.integers(0, 480, (4, 200)), rng.integers(0, 480, 200)
    before, old = pseudo_likelihood.Network(net.flat), net.log_probabilities(around, target).sum()
    net.step(around, target, pseudo_likelihood.Rates(net))
    moved = np.sqrt(((net.cls - before.cls) ** 2).sum(axis=1) + (net.cls_b - before.cls_b) ** 2)
    assert np.allclose(moved[:-1], pseudo_likelihood.RATE * pseudo_likelihood.DIM**0.5, rtol=1e-2)
    # a small share of that step improves the sum as the gradient says
    little = pseudo_likelihood.Network(before.flat + 1e-3 * (net.flat - before.flat))
    assert little.log_probabilities(around, target).sum() > old


def test_every_position_is_a_target_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pseudo_likelihood.Network, "step", lambda self, around, target, rate: seen.append(target.copy()))
    monkeypatch.setattr(pseudo_likelihood, "BATCH", 64)
    texts = pa.array([" ".join(f"w{i % 97}" for i in range(1000)), "a b c", None])

    class Rows:
        """Stands for a table of one task."""

        rdd = type("Rdd", (), {"getNumPartitions": lambda self: 1})()
        sparkSession = spark

        def mapInArrow(self, f, kind):
            batch = pa.RecordBatch.from_arrays([texts], names=["t"])
            made = list(f(iter([batch])))
            return spark.createDataFrame(pa.Table.from_batches(made))

    pseudo_likelihood.train(Rows(), np.zeros(0, np.uint64))
    assert sum(map(len, seen)) == 1003
