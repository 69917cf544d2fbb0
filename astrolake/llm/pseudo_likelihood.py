"""Language-model scoring by masked pseudo-likelihood.

A token is a lower-cased word.  Words with an exact count in the whole corpus of at least
``least_count`` (the square root of the tokens over 16, so the vocabulary grows with the
corpus up to ``MOST_WORDS``) have a number of their own; as surroundings all others share
hashed numbers, which form the last class.  A window network predicts a token from two tokens on each
side: the sum of one embedding per position, a tanh, and a softmax in two steps (class,
then token within class), with about as many classes as tokens in each.  A word without
a number has the probability of the last class times that of its spelling: a chain of
bytes counted over all such words of the corpus.  So each token has a probability of its
own, and for given surroundings these sum to at most one (the chain also spells words that
have a number).  The score of a document is the sum of log p(token | both sides) over all
its tokens.

Training covers all tokens of all documents.  A common start is learned from a bounded
sample (``started``).  In each round every task then starts from the shared parameters, runs
minibatch descent over the masked positions of its own documents (fixed by hash; the rounds
mask different ones, so over ``MASKED`` rounds each position is a target once), and the
results are averaged by the number of tokens, part by part, in two steps.  A row's step goes
by the gradients it has had, so rare words learn as well as frequent ones.  What is gathered
grows with the input; what reaches the driver is one set of parameters.

Defined cases: null and wordless texts have 0 tokens, score 0 and mean 0; before any
token is seen the parameters are the seeded ones; repeated rows score alike; other
columns are not returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.llm import packing, textops

#: The least network; a larger vocabulary has more and larger classes (``shape_for``).
CLASSES, PER_CLASS, OTHERS = 16, 32, 32
SIZE = CLASSES * PER_CLASS
WORDS = SIZE - OTHERS
DIM, SIDE = 16, 2
ROUNDS, MASKED, BATCH, SEED = 1, 1, 1 << 14, 3
#: Step length of a row whose gradients have all been alike.
RATE = 0.2
#: Positions whose odds are made at a time, so that they stay in a core's cache.
WIDTH = 512
#: Positions that the common start is learned from, in batches of so many, and how often at most a smaller corpus is gone over for it.
START_POSITIONS, START_BATCH, START_PASSES = 1 << 19, 1024, 8
#: Words with a number of their own at most; the network stays under 100 MB, and all other words are spelled.
MOST_WORDS = 1 << 18
PARTS = 8
#: The byte that stands before and after a word's own.
EDGE = 256


def least_count(tokens: int) -> int:
    """Count from which a word of a corpus has a number of its own."""
    return max(2, math.isqrt(tokens) // 16)


def shape_for(words: int) -> tuple[int, int]:
    """Classes, and tokens in each, for so many words and one class of others."""
    per = max(PER_CLASS, math.isqrt(words) + 1)
    return max(CLASSES, -(-words // per) + 1), per


class Network:
    """Parameters of the window network as one flat vector of float32."""

    def __init__(self, flat: np.ndarray | None = None, classes: int = CLASSES, per_class: int = PER_CLASS):
        self.classes, self.per_class = classes, per_class
        self.shapes = ((2 * SIDE, classes * per_class + 1, DIM), (DIM,), (classes, DIM), (classes,), (classes, per_class, DIM), (classes, per_class))
        sizes = [int(np.prod(s)) for s in self.shapes]
        if flat is None:
            rng = np.random.default_rng(SEED)
            flat = rng.normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.flat = flat.astype(np.float32).copy()
        ends = np.cumsum(sizes)
        self.emb, self.bias, self.cls, self.cls_b, self.tok, self.tok_b = (self.flat[e - n : e].reshape(s) for e, n, s in zip(ends, sizes, self.shapes, strict=True))

    def start_from(self, counts: np.ndarray, rest: int) -> None:
        """Biases that give each word its share of the corpus before any training."""
        share = np.full(self.classes * self.per_class, 0.5)
        share[: len(counts)] = counts
        share[-self.per_class :] = max(rest, 1) / self.per_class
        share = share.reshape(self.classes, self.per_class) / share.sum()
        self.cls_b[:] = np.log(share.sum(axis=1))
        self.tok_b[:] = np.log(share / share.sum(axis=1, keepdims=True))

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        h = np.take(self.emb[0], around[0], axis=0)
        h += self.bias
        one = np.empty_like(h)
        for j in range(1, 2 * SIDE):
            h += np.take(self.emb[j], around[j], axis=0, out=one, mode="clip")
        return np.tanh(h, out=h)

    @staticmethod
    def _scores(weights: np.ndarray, bias: np.ndarray, h1: np.ndarray) -> np.ndarray:
        """Scores with positions as columns, so that sums run over rows; biases are a column more of the weights."""
        return np.concatenate([weights, bias[:, None]], axis=1) @ h1.T

    def _small(self) -> bool:
        """No score can be so large that its exp is no number."""
        return max((np.abs(w).sum(axis=-1) + np.abs(b)).max() for w, b in ((self.cls, self.cls_b), (self.tok, self.tok_b))) < 80

    def _odds(self, weights: np.ndarray, bias: np.ndarray, h1: np.ndarray, small: bool) -> np.ndarray:
        """exp of the scores, over their largest unless all are ``small``."""
        z = self._scores(weights, bias, h1)
        if not small:
            z -= z.max(axis=0)
        return np.exp(z, out=z)

    def _by_class(self, target: np.ndarray):
        """An order of positions by class of the target, and (class, slice of that order) of each class that occurs."""
        c = target // self.per_class
        order = np.argsort(c.astype(np.min_scalar_type(self.classes)), kind="stable")
        return order, list(packing.by_bucket(c[order]))

    def _of_targets(self, weights: np.ndarray, bias: np.ndarray, h1: np.ndarray, at: np.ndarray, small: bool) -> np.ndarray:
        """Log-probability of row ``at`` in each column."""
        found = np.empty(len(at), np.float32)
        for a in range(0, len(at), WIDTH):
            some = slice(a, a + WIDTH)
            z = self._scores(weights, bias, h1[some])
            of = z[at[some], np.arange(z.shape[1])]
            if not small:
                top = z.max(axis=0)
                z -= top
                of -= top
            found[some] = of - np.log(np.exp(z, out=z).sum(axis=0))
        return found

    def log_probabilities(self, around: np.ndarray, target: np.ndarray, spelled: np.ndarray | None = None) -> np.ndarray:
        """Of the target numbers; or of the words themselves, given how the words without a number are ``spelled``."""
        out, small = np.empty(len(target), np.float32), self._small()
        order, parts = self._by_class(target)
        h1 = self._with_one(self._hidden(around[:, order]))
        c, t = target[order] // self.per_class, target[order] % self.per_class
        got = self._of_targets(self.cls, self.cls_b, h1, c, small)
        for k, rows in parts:
            if spelled is not None and k == self.classes - 1:
                got[rows] += spelled[order[rows]]
            else:
                got[rows] += self._of_targets(self.tok[k], self.tok_b[k], h1[rows], t[rows], small)
        out[order] = got
        return out

    @staticmethod
    def _with_one(h: np.ndarray) -> np.ndarray:
        h1 = np.empty((len(h), DIM + 1), np.float32)
        h1[:, :DIM], h1[:, DIM] = h, 1
        return h1

    def step(self, around: np.ndarray, target: np.ndarray, rates: Rates) -> None:
        """One descent step on the summed loss of a batch; each row goes by its own rate.

        Biases are a column more of the weights.  Sums of the odds divide the small sides of
        the products, and what targets take off is summed by target, so the odds themselves
        are made, added up and multiplied, but never rewritten."""
        per, last = self.per_class, self.classes - 1
        order = np.argsort(target.astype(np.min_scalar_type(self.emb.shape[1])), kind="stable")
        around, target = around[:, order], target[order]
        h, c = self._hidden(around), target // per
        h1, small = self._with_one(h), self._small()
        starts, _ = packing.groups(target)
        sums, of = np.add.reduceat(h1, starts, axis=0), target[starts]
        gh, d_cls = np.empty_like(h), np.zeros((self.classes, DIM + 1), np.float32)
        for a in range(0, len(c), WIDTH):
            near = h1[a : a + WIDTH]
            odds = self._odds(self.cls, self.cls_b, near, small)
            part = 1 / odds.sum(axis=0)[:, None]
            np.matmul(odds.T, self.cls, out=gh[a : a + WIDTH])
            gh[a : a + WIDTH] *= part
            d_cls += odds @ (near * part)
        gh -= self.cls[c]
        firsts, _ = packing.groups(of // per)
        d_cls[of[firsts] // per] -= np.add.reduceat(sums, firsts, axis=0)
        d_tok = np.zeros((self.classes, per, DIM + 1), np.float32)
        known = of < last * per  # a word without a number is spelled: of the network only its class counts
        d_tok.reshape(-1, DIM + 1)[of[known]] = -sums[known]
        for k, rows in packing.by_bucket(c):
            if k == last:
                break
            for a in range(rows.start, rows.stop, WIDTH):
                some = slice(a, min(a + WIDTH, rows.stop))
                odds = self._odds(self.tok[k], self.tok_b[k], h1[some], small)
                part = 1 / odds.sum(axis=0)[:, None]
                d = odds.T @ self.tok[k]
                d *= part
                d -= self.tok[k][target[some] - k * per]
                gh[some] += d
                d_tok[k] += odds @ (h1[some] * part)
        rate = rates.of(rates.tok, (d_tok * d_tok).sum(axis=2))
        self.tok -= rate[:, :, None] * d_tok[:, :, :DIM]
        self.tok_b -= rate * d_tok[:, :, DIM]
        rate = rates.of(rates.cls, (d_cls * d_cls).sum(axis=1))
        self.cls -= rate[:, None] * d_cls[:, :DIM]
        self.cls_b -= rate * d_cls[:, DIM]
        gh *= 1 - h * h
        d = gh.sum(axis=0)
        self.bias -= rates.of(rates.bias, (d * d).sum(keepdims=True)) * d
        short, by_place = np.min_scalar_type(self.emb.shape[1]), np.ascontiguousarray(gh.T)
        for j in range(2 * SIDE):
            # gradients of equal numbers are summed before they are taken off
            order = np.argsort(around[j].astype(short), kind="stable")
            near = around[j][order]
            starts, number = packing.groups(near)
            of = np.empty(len(near), np.int64)
            of[order] = number
            d = np.stack([np.bincount(of, g, len(starts)) for g in by_place], axis=1).astype(np.float32)
            rows = near[starts]
            self.emb[j][rows] -= rates.of(rates.emb[j], (d * d).sum(axis=1), rows)[:, None] * d


class Rates:
    """Squares of the gradients so far of each row of a network: a row's step is ``RATE`` over their root (per component)."""

    def __init__(self, net: Network, flat: np.ndarray | None = None):
        shapes = ((2 * SIDE, net.emb.shape[1]), (1,), (net.classes,), (net.classes, net.per_class))
        sizes = [int(np.prod(s)) for s in shapes]
        self.flat = np.full(sum(sizes), 1e-7, np.float32) if flat is None else flat.copy()
        ends = np.cumsum(sizes)
        self.emb, self.bias, self.cls, self.tok = (self.flat[e - n : e].reshape(s) for e, n, s in zip(ends, sizes, shapes, strict=True))

    @staticmethod
    def of(seen: np.ndarray, squares: np.ndarray, rows=slice(None)) -> np.ndarray:
        """The rates of the rows, once the new squares are counted."""
        now = seen[rows] + squares
        seen[rows] = now
        return np.float32(RATE * math.sqrt(DIM)) / np.sqrt(now)


def numbers(words: textops.Words, vocabulary: np.ndarray, number: np.ndarray, classes: int = CLASSES, per_class: int = PER_CLASS, hashes: np.ndarray | None = None) -> np.ndarray:
    """Token numbers: the word's own, or a hashed one among the others (the last class); ``hashes`` of the words, if they are known."""
    h = words.hashes() if hashes is None else hashes
    out = ((classes - 1) * per_class + (h % np.uint64(per_class)).astype(np.int64)).astype(np.int64)
    if len(vocabulary) and len(h):
        slot = np.searchsorted(vocabulary, h)
        slot[slot == len(vocabulary)] = 0
        hit = vocabulary[slot] == h
        out[hit] = number[slot[hit]]
    return out


def surroundings(ids: np.ndarray, bounds: np.ndarray, outside: int = SIZE) -> np.ndarray:
    """Numbers of the tokens around each token, row-wise; beyond a text's ends stands a number of its own."""
    n, rows = len(ids), len(bounds) - 1
    padded = np.full(n + SIDE * (rows + 1), outside, np.int32)
    at = np.arange(n) + SIDE * (np.repeat(np.arange(rows), np.diff(bounds)) + 1)
    padded[at] = ids
    return np.stack([padded[at + j] for j in (*range(-SIDE, 0), *range(1, SIDE + 1))])


def word_counts(texts: DataFrame, n_buckets: int) -> DataFrame:
    """(h, c): hash and exact count of every word."""

    def count(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0

        def flush():
            h = np.concatenate([a for a, _ in held])
            c = np.concatenate([b for _, b in held])
            order = np.argsort(h, kind="stable")
            starts, _ = packing.groups(h[order])
            h, c = h[order][starts], np.add.reduceat(c[order], starts)
            bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
            return packing.blob_batch((b, packing.pack(packing.delta(h[s]), c[s].astype(np.uint32))) for b, s in packing.by_bucket(bucket))

        for batch in batches:
            for part in textops.pieces(batch, "t"):
                h = textops.Words(*textops.raw(part.column("t")), textops.ALNUM_WORD).hashes()
                if len(h):
                    held.append(np.unique(h, return_counts=True))
                size += part.nbytes
                if size >= packing.FLUSH_BYTES and held:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def total(table: pa.Table) -> pa.Table:
        got = [packing.unpack(b) for b in table.column("blob").to_pylist()]
        h = np.concatenate([packing.undelta(a) for a, _ in got])
        c = np.concatenate([b for _, b in got]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        starts, _ = packing.groups(h[order])
        h, c = h[order][starts], np.add.reduceat(c[order], starts)
        return pa.table({"h": pa.array(h.view(np.int64), pa.int64()), "c": pa.array(c, pa.int64())})

    return texts.mapInArrow(count, packing.BLOB_SCHEMA).groupBy("bucket").applyInArrow(total, "h long, c long")


def vocabulary_of(texts: DataFrame, n_buckets: int, words: int = WORDS) -> np.ndarray:
    """Hashes of the most frequent words, most frequent first (ties by hash)."""
    best = word_counts(texts, n_buckets).orderBy(F.desc("c"), "h").limit(words)
    return np.array([r["h"] for r in best.collect()], np.int64).view(np.uint64)


def full_vocabulary(texts: DataFrame, n_buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of the words of at least ``least_count`` (up to ``MOST_WORDS``), most frequent first (ties by hash), and the tokens of all others."""
    counts = packing.written(word_counts(texts, n_buckets), "word-counts")
    tokens = int(counts.agg(F.sum("c")).first()[0] or 0)
    found = counts.where(F.col("c") >= least_count(tokens)).orderBy(F.desc("c"), "h").limit(MOST_WORDS).toArrow()
    h, c = found.column("h").to_numpy(), found.column("c").to_numpy()
    top = np.lexsort((h, -c))
    return h[top].view(np.uint64), c[top], tokens - int(c.sum())


def _steps(words: textops.Words, rare: np.ndarray) -> np.ndarray:
    """Byte pairs of the rare words as numbers, edges included."""
    first, last = words.start[rare], words.end[rare] - 1
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[first] += 1
    inside[last] -= 1
    at = np.flatnonzero(np.cumsum(inside, dtype=np.int8))
    data = words.data.astype(np.int64)
    return np.concatenate([EDGE * (EDGE + 1) + data[first], data[at] * (EDGE + 1) + data[at + 1], data[last] * (EDGE + 1) + EDGE])


def spelling_of(seen: np.ndarray) -> np.ndarray:
    """Log-probabilities of the next byte (or the end) after a byte (or the start), from counts of byte pairs."""
    may = np.r_[textops.ALNUM_WORD, True]
    seen = np.where(may[:, None] & may[None], seen.reshape(EDGE + 1, EDGE + 1) + 0.5, 0)
    seen[EDGE, EDGE] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(seen > 0, np.log(seen / seen.sum(axis=1, keepdims=True)), 0.0)


def spelling(texts: DataFrame, ranked: np.ndarray) -> np.ndarray:
    """The spelling of all words outside the vocabulary."""
    return train(texts, ranked, rounds=1)[1]


def spelled(words: textops.Words, table: np.ndarray) -> np.ndarray:
    """Log-probability of each word's bytes."""
    if not len(words.start):
        return np.zeros(0)
    data = words.data.astype(np.int64)
    run = np.r_[0.0, np.cumsum(table[data[:-1], data[1:]])]
    last = words.end - 1
    return table[EDGE, data[words.start]] + run[last] - run[words.start] + table[data[last], EDGE]


def started(texts: DataFrame, ranked: np.ndarray, shape: tuple[int, int], counts: np.ndarray, rest: int) -> tuple[Network, Rates]:
    """The network from which all tasks start, learned by one task from a bounded sample of texts, and the rates it has come to.

    Tasks that start from noise learn the same in different directions, and their average
    forgets it; from a common start they go on in the same ones.  The sample is of about
    ``START_POSITIONS`` tokens, different texts chosen by hash."""
    net = Network(None, *shape)
    net.start_from(counts, rest)
    share = min(1.0, START_POSITIONS / max(int(counts.sum()) + rest, 1))
    key = F.xxhash64("t", F.lit(SEED))
    few = texts.where(F.col("t").isNotNull() & (F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30)))).distinct()
    order = np.argsort(ranked)
    held = texts.sparkSession.sparkContext.broadcast((ranked[order], order, net.flat))

    def learn(batches: Iterator[pa.RecordBatch]):
        vocabulary, number, flat = held.value
        own, found = Network(flat, *shape), []
        rates = Rates(own)
        for batch in batches:
            for part in textops.pieces(batch, "t"):
                words = textops.Words(*textops.raw(part.column("t")), textops.ALNUM_WORD)
                ids = numbers(words, vocabulary, number, *shape)
                found.append((surroundings(ids, words.bounds, shape[0] * shape[1]), ids))
        if found:
            around, target = np.concatenate([f[0] for f in found], axis=1), np.concatenate([f[1] for f in found])
            for turn in range(min(START_PASSES, -(-START_POSITIONS // max(len(target), 1)))):
                mixed = np.random.default_rng(turn).permutation(len(target))
                for i in range(0, len(mixed), START_BATCH):
                    own.step(around[:, mixed[i : i + START_BATCH]], target[mixed[i : i + START_BATCH]], rates)
            yield pa.RecordBatch.from_arrays([pa.array([packing.pack(own.flat, rates.flat)], pa.binary())], names=["values"])

    # one task, in an order that does not depend on how rows are dealt
    made = few.withColumn("_h", key).repartition(1).sortWithinPartitions("_h", "t").select("t").mapInArrow(learn, "values binary").collect()
    if made:
        flat, seen = packing.unpack(made[0]["values"])
        net = Network(flat, *shape)
        return net, Rates(net, seen)
    return net, Rates(net)


def train(texts: DataFrame, ranked: np.ndarray, rounds: int = ROUNDS, masked: int = MASKED, shape: tuple[int, int] = (CLASSES, PER_CLASS), start: tuple[Network, Rates] | None = None) -> tuple[Network, np.ndarray]:
    """Rounds of local descent on all documents and averaging, from a common ``start``; and the spelling of words without a number, counted in the first round."""
    order = np.argsort(ranked)
    pairs = np.zeros((EDGE + 1) ** 2)
    net = start[0] if start else Network(None, *shape)
    first = start[1].flat if start else None
    # results of the tasks are averaged in two steps, so that no group has more than about the root of their number
    lanes = max(1, math.isqrt(texts.rdd.getNumPartitions()))
    for turn in range(rounds):
        held = texts.sparkSession.sparkContext.broadcast((ranked[order], order, net.flat, first))

        def descend(batches: Iterator[pa.RecordBatch], held=held, turn=turn):
            vocabulary, number, flat, squares = held.value
            own, seen, steps, pairs = Network(flat, *shape), 0, 0, np.zeros((EDGE + 1) ** 2, np.int64)
            rates = Rates(own, squares)
            around, target = np.zeros((2 * SIDE, 0), np.int32), np.zeros(0, np.int64)
            wait_a, wait_t, waiting = [], [], 0

            def learn(last: bool):
                """Full batches of what waits, in mixed order; the rest goes on to the next call, or is learned if it is the ``last``."""
                nonlocal around, target, steps, wait_a, wait_t, waiting
                a, t = np.concatenate([around, *wait_a], axis=1), np.concatenate([target, *wait_t])
                mixed = np.random.default_rng(steps).permutation(len(t))
                end = len(t) if last else len(t) // BATCH * BATCH
                for i in range(0, end, BATCH):
                    b = mixed[i : min(i + BATCH, end)]
                    own.step(a[:, b], t[b], rates)
                    steps += 1
                around, target, wait_a, wait_t, waiting = a[:, mixed[end:]], t[mixed[end:]], [], [], 0

            for batch in batches:
                for part in textops.pieces(batch, "t"):
                    words = textops.Words(*textops.raw(part.column("t")), textops.ALNUM_WORD)
                    hashes = words.hashes()
                    ids = numbers(words, vocabulary, number, *shape, hashes)
                    near = surroundings(ids, words.bounds, shape[0] * shape[1])
                    if turn == 0:
                        pairs += np.bincount(_steps(words, ids >= (shape[0] - 1) * shape[1]), minlength=len(pairs))
                    # each round hides other positions
                    place = np.arange(len(ids), dtype=np.uint64) - words.bounds[:-1].astype(np.uint64).repeat(np.diff(words.bounds))
                    hidden = textops.mix(hashes + place * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(masked) == turn % masked
                    wait_a.append(near[:, hidden])
                    wait_t.append(ids[hidden])
                    waiting += int(hidden.sum())
                    seen += len(ids)
                    if waiting >= 8 * BATCH:
                        learn(False)
            if waiting or len(target):
                learn(True)
            if seen:
                pieces = [packing.pack(p) for p in np.array_split(own.flat - flat, PARTS)] + ([packing.pack(pairs)] if turn == 0 else [])
                lane = int(textops.mix(np.array([seen], np.uint64))[0] % np.uint64(lanes))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int64()), pa.array([lane] * len(pieces), pa.int64()), pa.array([seen] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], names=["part", "lane", "n", "values"])

        def average(table: pa.Table) -> pa.Table:
            """Weighted mean of parameters; the sum of counts (the part after the last)."""
            sums = table.column("part")[0].as_py() == PARTS
            table = table.sort_by([("n", "ascending"), ("values", "ascending")])
            n, total = table.column("n").to_numpy().astype(np.float64), 0.0
            for w, v in zip(n, table.column("values"), strict=True):
                found = packing.unpack(v.as_py())[0]
                total = total + (found if sums else w * found.astype(np.float64))
            made = total if sums else (total / n.sum()).astype(np.float32)
            return pa.table({"part": table.column("part")[:1], "lane": table.column("lane")[:1], "n": pa.array([int(n.sum())], pa.int64()), "values": pa.array([packing.pack(made)], pa.binary())})

        kind = "part long, lane long, n long, values binary"
        done = texts.mapInArrow(descend, kind).groupBy("part", "lane").applyInArrow(average, kind).groupBy("part").applyInArrow(average, kind).orderBy("part").collect()
        if done:
            net = Network(net.flat + np.concatenate([packing.unpack(r["values"])[0] for r in done[:PARTS]]), *shape)
            pairs = packing.unpack(done[PARTS]["values"])[0] if turn == 0 else pairs
    return net, spelling_of(pairs)


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, masked: int = MASKED) -> DataFrame:
    """One row per document: its id, n_tokens, score (sum of conditional log-probabilities) and mean_score."""
    texts = docs.select(F.col(text).alias("t"))
    _, size = packing.text_size(texts, "t")
    ranked, counts, rest = full_vocabulary(texts, packing.bucket_count(size, 32 << 20))
    shape = shape_for(len(ranked))
    net, table = train(texts, ranked, rounds, masked, shape, started(texts, ranked, shape, counts, rest))
    order = np.argsort(ranked)
    held = docs.sparkSession.sparkContext.broadcast((ranked[order], order, net.flat, table))

    def run(batches: Iterator[pa.RecordBatch]):
        vocabulary, number, flat, table = held.value
        own = Network(flat, *shape)
        for batch in batches:
            for part in textops.pieces(batch, "t"):
                words = textops.Words(*textops.raw(part.column("t")), textops.ALNUM_WORD)
                ids = numbers(words, vocabulary, number, *shape)
                around = surroundings(ids, words.bounds, shape[0] * shape[1])
                log_p, spelt = np.zeros(len(ids)), spelled(words, table)
                for i in range(0, len(ids), BATCH):
                    log_p[i : i + BATCH] = own.log_probabilities(around[:, i : i + BATCH], ids[i : i + BATCH], spelt[i : i + BATCH])
                n = np.diff(words.bounds)
                total = np.diff(np.r_[0.0, np.cumsum(log_p)][words.bounds])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(total / np.maximum(n, 1), pa.float64())], names=["doc_id", "n_tokens", "score", "mean_score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, n_tokens long, score double, mean_score double")
