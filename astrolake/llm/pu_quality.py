"""Quality classifier by positive-unlabelled learning.

A document is described by shape features of its whole text (character classes,
word lengths, repetition).  The model is a small network trained in numpy on the
non-negative unbiased PU risk

    pi * R+(positives)  +  max(0, R-(unlabelled) - pi * R-(positives)),

with trusted positives (documents labelled good, learning folds only) and unlabelled
web text (any documents of the learning folds, labels unused).  Where the bracket is
negative the gradient is turned, which keeps the risk from going below zero by
memorising positives.  Documents labelled poor are never used as such.

The class prior pi is estimated from positives and unlabelled text alone: a network that
tells the two apart ranks held-out rows of both; the share of unlabelled rows above a
threshold over that of positives is at least pi, and the threshold where the upper
confidence bound of this ratio is least gives the estimate (best bin).  The cut is put where the
non-negative PU risk of the zero-one loss on held-out rows is least.

Training takes a bounded sample (``MAX_POSITIVE`` and ``MAX_UNLABELLED`` rows, by
hash); scoring is one pass over all rows without a shuffle.

Defined cases: null and empty texts have the features of an empty text and get a
score; with fewer than eight positives or rows every score is one half; repeated rows score alike;
other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.llm import packing, textops

MAX_POSITIVE, MAX_UNLABELLED = 8000, 8000
HIDDEN, EPOCHS, RATE, BATCH, SEED = 16, 60, 0.01, 256, 7
MIN_STEPS = 800
#: Every HELD-th sampled row is kept from training, for the prior and the cut.
HELD = 4
CUT = 0.7

#: Characters whose shares are features, each string one class.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!?", "%&$*#@^~", "|<>[]{}()=+", "\n", "-_:;/\\\"'")


def _table() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for i, chars in enumerate(CLASSES):
        kinds[np.frombuffer(chars.encode(), np.uint8)] = i + 1
    return kinds


_KIND = _table()
N_FEATURES = len(CLASSES) + 9


def features(part: pa.RecordBatch, column: str) -> np.ndarray:
    """One row of float features per text of the slice."""
    data, offsets = textops.raw(part.column(column))
    n = part.num_rows
    size = np.diff(offsets).astype(np.float64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kind = _KIND[data]
    counts = np.bincount(row * 16 + kind, minlength=n * 16).reshape(n, 16)[:, 1 : len(CLASSES) + 1]
    words = textops.Words(data, offsets, textops.BLANK_WORD)
    n_words = np.diff(words.bounds).astype(np.float64)
    h = words.hashes()
    owner = np.repeat(np.arange(n), np.diff(words.bounds))
    length = (words.end - words.start).astype(np.float64)
    one, w = np.maximum(size, 1), np.maximum(n_words, 1)

    def distinct(keys, rows):
        order = np.lexsort((keys, rows))
        starts, _ = packing.groups(rows[order], keys[order]) if len(keys) else (np.zeros(0, np.int64), None)
        return np.bincount(rows[order][starts], minlength=n).astype(np.float64)

    pair = h[:-1] * np.uint64(31) + h[1:] if len(h) else h
    same_row = owner[1:] == owner[:-1]
    pairs = np.bincount(owner[1:][same_row], minlength=n)
    last = _KIND[words.data[words.end - 1]] if len(h) else np.zeros(0, np.uint8)
    out = np.empty((n, N_FEATURES))
    out[:, : len(CLASSES)] = np.sqrt(counts / one[:, None])
    at = len(CLASSES)
    out[:, at] = np.log1p(size)
    out[:, at + 1] = np.bincount(owner, weights=length, minlength=n) / w
    out[:, at + 2] = np.bincount(owner, weights=(length >= 12), minlength=n) / w
    out[:, at + 3] = np.log1p(w / np.maximum(distinct(h, owner), 1))
    out[:, at + 4] = np.log1p(pairs / np.maximum(distinct(pair[same_row], owner[1:][same_row]), 1))
    out[:, at + 5] = np.bincount(owner[1:][same_row], weights=(h[1:] == h[:-1])[same_row], minlength=n) / w
    out[:, at + 6] = np.bincount(owner, weights=(last >= 5), minlength=n) / w
    out[:, at + 7] = np.bincount(row, weights=(data >= 0x80), minlength=n) / one
    out[:, at + 8] = n_words == 0
    return out


class Network:
    """One hidden layer, trained on the non-negative PU risk with the logistic loss; without a prior, to tell positives from unlabelled rows."""

    def __init__(self, x_pos: np.ndarray, x_unl: np.ndarray, prior: float | None, hidden: int = HIDDEN, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        both = np.vstack([x_pos, x_unl])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        d = both.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(0.0 if prior is None else np.log(prior / (1 - prior)))]
        self.shift = 0.0
        xp, xu = self._scaled(x_pos), self._scaled(x_unl)
        moment, square, t = [np.zeros_like(v) for v in self.p], [np.zeros_like(v) for v in self.p], 0
        epochs = max(epochs, -(-MIN_STEPS * BATCH // max(len(xp), len(xu), BATCH)))
        for _ in range(epochs):
            a, b = rng.permutation(len(xp)), rng.permutation(len(xu))
            steps = max(1, max(len(a), len(b)) // BATCH)
            for i in range(steps):
                bp, bu = xp[np.take(a, range(i * BATCH, (i + 1) * BATCH), mode="wrap")], xu[np.take(b, range(i * BATCH, (i + 1) * BATCH), mode="wrap")]
                t += 1
                for j, g in enumerate(self._gradient(bp, bu, prior)):
                    g = g + 1e-4 * self.p[j]
                    moment[j] = 0.9 * moment[j] + 0.1 * g
                    square[j] = 0.999 * square[j] + 0.001 * g * g
                    self.p[j] = self.p[j] - rate * (moment[j] / (1 - 0.9**t)) / (np.sqrt(square[j] / (1 - 0.999**t)) + 1e-8)

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _forward(self, x):
        h = np.tanh(x @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3]

    def _backward(self, x, h, gz):
        gh = np.outer(gz, self.p[2]) * (1 - h * h)
        return [x.T @ gh, gh.sum(axis=0), h.T @ gz, gz.sum()]

    def _gradient(self, bp, bu, prior):
        hp, zp = self._forward(bp)
        hu, zu = self._forward(bu)
        if prior is None:
            return [u + v for u, v in zip(self._backward(bp, hp, (1 / (1 + np.exp(-zp)) - 1) / len(bp)), self._backward(bu, hu, 1 / (1 + np.exp(-zu)) / len(bu)), strict=True)]
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        # loss l(z, +1) = log(1 + e^-z), l(z, -1) = log(1 + e^z)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_pos = self._backward(bp, hp, prior * (sp - 1) / len(bp))
        g_neg = [u - v for u, v in zip(self._backward(bu, hu, su / len(bu)), self._backward(bp, hp, prior * sp / len(bp)), strict=True)]
        if negative < 0:
            return [-v for v in g_neg]
        return [u + v for u, v in zip(g_pos, g_neg, strict=True)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._forward(self._scaled(x))[1] + self.shift

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))

    def calibrate(self, x_pos: np.ndarray, x_unl: np.ndarray, prior: float, cut: float) -> None:
        """Move logits so that the cut falls in the middle of where the PU risk of the zero-one loss is least."""
        zp, zu = np.sort(self.logit(x_pos)), np.sort(self.logit(x_unl))
        edge = np.unique(np.r_[zp, zu])
        edge = np.r_[edge[0] - 1, (edge[1:] + edge[:-1]) / 2, edge[-1] + 1]
        missed = np.searchsorted(zp, edge) / len(zp)
        taken = 1 - np.searchsorted(zu, edge) / len(zu)
        risk = prior * missed + np.maximum(0, taken - prior * (1 - missed))
        near = np.flatnonzero(risk <= risk.min() + 0.5 / len(zu))
        self.shift += np.log(cut / (1 - cut)) - float(edge[near[0]] + edge[near[-1]]) / 2


def class_prior(z_pos: np.ndarray, z_unl: np.ndarray, doubt: float = 0.1) -> float:
    """Share of positives among unlabelled rows, from held-out scores of both: best bin estimation."""
    zp, zu = np.sort(z_pos), np.sort(z_unl)
    at = np.unique(zp)
    q_pos, q_unl = 1 - np.searchsorted(zp, at) / len(zp), 1 - np.searchsorted(zu, at) / len(zu)
    slack = np.sqrt(np.log(4 / doubt) / 2) * (len(zp) ** -0.5 + len(zu) ** -0.5)
    best = int(np.argmin((q_unl + 1.01 * slack) / q_pos))
    return float(min(max(q_unl[best] / q_pos[best], 0.02), 0.98))


def _sampled(df: DataFrame, most: int, rows: int) -> DataFrame:
    """About the ``most`` rows of least hash: a bounded sample."""
    share = min(1.0, most / max(rows, 1))
    return df.where(F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))


def _collect_features(df: DataFrame) -> np.ndarray:
    """Features of a bounded sample, in an order of their own, so that no row order of the input matters."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in textops.pieces(batch, "_text"):
                yield pa.RecordBatch.from_arrays([pa.array(list(features(part, "_text")), pa.list_(pa.float64()))], names=["x"])

    got = df.select("_text").mapInArrow(run, "x array<double>").toArrow()
    x = np.array(got.column("x").combine_chunks().flatten().to_numpy()).reshape(-1, N_FEATURES)
    return np.random.default_rng(SEED).permutation(x[np.lexsort(x.T)])


def train(docs: DataFrame, labels: DataFrame, learning, doc_id: str = "doc_id", text: str = "text", label: str = "quality", cut: float = CUT) -> Network | float:
    """The network, or a constant score where there are no positives.  ``learning``: condition on ``_id`` for rows to learn from."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).where(learning)
    good = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_y")).where(learning & (F.col("_y") == 1)).select("_id").distinct()
    n_rows, n_good = rows.count(), good.count()
    x_pos = _collect_features(rows.join(F.broadcast(_sampled(good, MAX_POSITIVE, n_good)), "_id"))
    x_unl = _collect_features(_sampled(rows, MAX_UNLABELLED, n_rows))
    if len(x_pos) < 2 * HELD or len(x_unl) < 2 * HELD:
        return 0.5
    held_pos, held_unl = np.arange(len(x_pos)) % HELD == 0, np.arange(len(x_unl)) % HELD == 0
    apart = Network(x_pos[~held_pos], x_unl[~held_unl], None)
    prior = class_prior(apart.logit(x_pos[held_pos]), apart.logit(x_unl[held_unl]))
    net = Network(x_pos[~held_pos], x_unl[~held_unl], prior)
    net.calibrate(x_pos[held_pos], x_unl[held_unl], prior, cut)
    net.prior = prior
    return net


def scored(docs: DataFrame, model: Network | float, text: str = "text", name: str = "_score") -> DataFrame:
    """``docs`` with the score in the column ``name``, which replaces one of that name."""
    rows = packing.wrapped(docs, text=text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        net = held.value
        for batch in batches:
            for part in textops.pieces(batch, "text"):
                s = np.full(part.num_rows, net) if isinstance(net, float) else net.score(features(part, "text"))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(s, pa.float64())], names=["doc", "score"])

    done = rows.mapInArrow(run, packing.extended(rows.select("doc"), "score double"))
    return done.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c != name], F.col("score").alias(name))


def keep_good(docs: DataFrame, labels: DataFrame, learning, doc_id: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """The documents whose score reaches the cut, with all their columns."""
    model = train(docs, labels, learning, doc_id=doc_id, text=text, cut=cut)
    return scored(packing.wrapped(docs, text=text), model).where(F.col("_score") >= cut).select("doc.*")
