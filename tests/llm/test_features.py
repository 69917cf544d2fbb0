"""Features of the two classifiers against plain loops over texts."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from astrolake.llm import pu_quality, toxicity

BLANK, WORD = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts(rng, bits, n):
    return [None, "", " \n", "x", "A.B,C!? %&", "é" * 40, "word " * 30000] + [" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def plain_quality(text):
    b = (text or "").encode()
    words = BLANK.findall(b)
    low = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    one, w = max(len(b), 1), max(len(words), 1)
    out = [math.sqrt(sum(c in x.encode() for c in b) / one) for x in pu_quality.CLASSES]
    pairs = list(zip(low, low[1:], strict=False))
    out += [math.log1p(len(b)), sum(map(len, words)) / w, sum(len(x) >= 12 for x in words) / w]
    out += [math.log1p(w / max(len(set(low)), 1)), math.log1p(len(pairs) / max(len(set(pairs)), 1)), sum(x == y for x, y in pairs) / w]
    signs = set("".join(pu_quality.CLASSES[4:]).encode())
    out += [sum(x[-1] in signs for x in words) / w, sum(c >= 0x80 for c in b) / one, float(not words)]
    return out


def test_quality_features():
    rng = random.Random(1)
    bits = ["the", "The", "of", "a", "word", "word", "extraordinarily", "end.", "what?", "{x}", "12,5", "ß", "\n", "internationalisation", "a-b", "ünï", "!"]
    said = texts(rng, bits, 120)
    got = pu_quality.features(pa.RecordBatch.from_arrays([pa.array(said)], names=["t"]), "t")
    assert got.shape == (len(said), pu_quality.N_FEATURES) and np.allclose(got, [plain_quality(t) for t in said])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_toxicity(text, lexicon, terms, weights, clean):
    """Quotations by straight marks alone, which open and close in turn on each line."""
    t = text or ""
    b, turn, marks = t.encode(), 1, []
    for i, c in enumerate(b):
        if c == 0x0A:
            turn = 1
        elif c == 0x22:
            marks.append((i, turn))
            turn = -turn
    pairs = [(a, z) for (a, x), (z, y) in zip(marks, marks[1:], strict=False) if x == 1 and y == -1]
    hits = []
    found = list(WORD.finditer(bytes(c + 32 if 65 <= c <= 90 else 32 if c == 0x22 else c for c in b)))
    for i, m in enumerate(found):
        word = m.group().decode()
        quoted = any(a < m.start() < z for a, z in pairs)
        if word in terms:
            hits.append((i, word, weights[terms.index(word)], False, quoted))
        elif word not in clean and any(len(x) >= toxicity.SHORTEST and edits(word, x) == 1 for x in terms):
            hits.append((i, word, lexicon.misspelled(word), True, quoted))
    out, near = [0.0] * toxicity.N_FEATURES, [sum(abs(h[0] - o[0]) <= toxicity.WINDOW for o in hits) for h in hits]
    first = [all(o[1] != h[1] for o in hits[:k]) for k, h in enumerate(hits)]
    total = lambda ok, value: sum(value(h) for k, h in enumerate(hits) if ok(h, first[k]))
    if hits:
        out[0] = math.log1p(total(lambda h, f: not h[4] and not h[3] and f, lambda h: h[2]))
        out[1] = math.log1p(total(lambda h, f: not h[4] and not h[3], lambda h: 1.0))
        out[2] = max([h[2] for h in hits if not h[4] and not h[3]], default=0.0)
        out[3] = math.log1p(total(lambda h, f: not h[4] and h[3] and f, lambda h: h[2]))
        out[4] = math.log1p(total(lambda h, f: not h[4] and h[3], lambda h: 1.0))
        out[5] = max([math.log(n) for h, n in zip(hits, near, strict=True) if not h[4]], default=0.0)
        out[6] = math.log1p(total(lambda h, f: h[4], lambda h: h[2]))
        out[7] = math.sqrt(out[1] / max(math.log1p(len(found)), 1))
    return out


def test_toxicity_features():
    rng = random.Random(2)
    terms, weights, clean = ["horrid", "wretch", "vile", "blighter"], [5.0, 4.0, 3.0, 6.0], ["torrid", "wretches"]
    lexicon = toxicity.Lexicon(terms, weights, clean)
    bits = ["the", "a", "word", "horrid", "HORRID", "horid", "torrid", "wretch", "wretched", "wretches", "wertch", "vile", "vil", "vilee", "blighter", "blightre", "blihter", '"', '"', '"horrid"', "\n", "é", "horríd"]
    said = texts(rng, bits, 200)
    got = toxicity.features(pa.RecordBatch.from_arrays([pa.array(said)], names=["t"]), "t", lexicon)
    for t, x in zip(said, got, strict=True):
        assert np.allclose(x, plain_toxicity(t, lexicon, terms, weights, clean)), t


@pytest.mark.parametrize("seed", [1, 2])
def test_logistic_fit_is_the_minimum(seed):
    """No step from the fitted weights lowers the penalised loss."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, toxicity.N_FEATURES)) ** 2
    y = (x[:, 0] + 0.5 * x[:, 3] + rng.normal(size=300) > 1.5).astype(int)
    model = toxicity.Model(toxicity.Lexicon(["horrid"], [1.0], []), 0.3)
    model.fit(x, y)
    z = x / model.scale

    def loss(w, b):
        s = z @ w + b
        return np.logaddexp(0, s).sum() - (y * s).sum() + 0.5 * (w * w).sum()

    # the bias was moved to part the rows best; the weights are those of the minimum over both
    best = min((loss(model.w, b), b) for b in np.linspace(model.b - 6, model.b + 6, 4001))
    for i in range(toxicity.N_FEATURES):
        for d in (-0.05, 0.05):
            w = model.w.copy()
            w[i] += d
            assert loss(w, best[1]) > best[0] - 1e-3
    assert np.mean((model.logit(x) > 0) == (y == 1)) > 0.75
