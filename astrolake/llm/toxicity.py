"""Toxicity by a lexicon that also catches misspelled terms, with quotation told from abuse.

1. Terms are learned from labelled rows: words whose document frequency among toxic
   rows exceeds that among clean ones by a log-odds of ``MIN_ODDS`` and a likelihood
   ratio of ``MIN_RATIO``, the strongest ``MAX_TERMS``.
2. A word matches a term exactly, or misspelled: the Levenshtein automaton of the word
   (one edit) is intersected with the trie of all terms, so one walk covers the whole
   lexicon.  Words of clean learning rows are never misspellings.  Only words that share
   three quarters with some term reach the automaton (one edit leaves these intact).
3. An occurrence between an opening and a closing quotation mark, however far apart, is a
   quotation and counted apart from abuse; terms within ``WINDOW`` words weigh more.
4. A logistic model over these sums, fitted on learning rows that did not teach terms,
   gives the score, moved so that 0.5 parts its learning rows best.

Only one edit counts (a swap of two letters is two), in terms of ``SHORTEST`` letters or more.
Learning uses a bounded sample of labelled rows (``MAX_LABELLED``); scoring is one pass
over all rows, whole texts, without a shuffle.

Defined cases: null and empty texts score like a text without terms; without toxic
labels every score is the smoothed rate of the label; an id with labels of both kinds is
toxic; repeated rows score alike; other columns are passed through, but for one of the
score's own name.  Words seen in fewer than ``MIN_DOCS`` toxic rows are no terms.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.llm import packing, textops

MAX_LABELLED, MAX_TERMS = 30000, 4096
MIN_ODDS, MIN_RATIO, MIN_DOCS = 3.0, 16.0, 3
WINDOW = 8
SEED = 11
#: Letters a term has at least to be found misspelled.
SHORTEST = 5
N_FEATURES = 8

_QUOTES = np.zeros(256, bool)
_QUOTES[np.frombuffer(b'"', np.uint8)] = True
#: UTF-8 of quotation marks that open (201C, 201E, 201F, 00AB) and close (201D, 00BB).
_QUOTE_BYTES = {b"\xe2\x80\x9c": 1, b"\xe2\x80\x9e": 1, b"\xe2\x80\x9f": 1, b"\xc2\xab": 1, b"\xe2\x80\x9d": -1, b"\xc2\xbb": -1}


class Trie:
    """Terms as nested dicts; key None holds the term's number."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for i, term in enumerate(terms):
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[None] = i


class Automaton:
    """Levenshtein automaton of a word: states are sets of (letters read, edits spent)."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits

    def _closed(self, states) -> frozenset:
        """With letters of the word skipped, and states that another one covers left out."""
        best: dict[int, int] = {}
        for i, e in states:
            while e <= self.edits and i <= len(self.word):
                if best.get(i, self.edits + 1) <= e:
                    break
                best[i] = e
                i, e = i + 1, e + 1
        return frozenset(best.items())

    def start(self) -> frozenset:
        return self._closed([(0, 0)])

    def step(self, states: frozenset, c: str) -> frozenset:
        out = []
        for i, e in states:
            if i < len(self.word) and self.word[i] == c:
                out.append((i + 1, e))
            if e < self.edits:
                out.append((i, e + 1))
                if i < len(self.word):
                    out.append((i + 1, e + 1))
        return self._closed(out)

    def accepts(self, states: frozenset) -> bool:
        return any(i == len(self.word) for i, _ in states)

    def intersect(self, trie: Trie) -> list[int]:
        """Numbers of the terms within the edits of the word."""
        found, todo = [], [(trie.root, self.start())]
        while todo:
            node, states = todo.pop()
            for c, below in node.items():
                if c is None:
                    if self.accepts(states):
                        found.append(below)
                elif after := self.step(states, c):
                    todo.append((below, after))
        return found


def char_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 characters that start at each byte (1 inside of characters)."""
    return 1 + (data >= 0xC0).astype(np.int64) + (data >= 0xE0) + (data >= 0xF0)


def ends_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, ahead: int, behind: int, view: np.ndarray | None = None) -> np.ndarray:
    """Hash of the first ``ahead`` and the last ``behind`` bytes of each span."""
    view = textops.eights(data) if view is None else view
    return textops.mix(textops.span_hashes(data, start, start + ahead, view) * np.uint64(3) + textops.span_hashes(data, end - behind, end, view))


def word_hash(term: bytes) -> int:
    data = np.frombuffer(term, np.uint8)
    return int(textops.span_hashes(data, np.array([0]), np.array([len(data)]))[0])


class Lexicon:
    """Terms with weights, found exactly or misspelled in slices of texts."""

    def __init__(self, terms: list[str], weights: list[float], clean: list[str]):
        raw = [t.encode() for t in terms]
        h = np.array([word_hash(t) for t in raw], np.uint64)
        order = np.argsort(h)
        self.hashes, self.weights = h[order], np.array(weights, np.float64)[order]
        self.terms = [terms[i] for i in order]
        self.trie = Trie(self.terms)
        self.clean = np.sort(np.array([word_hash(c.encode()) for c in clean], np.uint64)) if clean else np.zeros(0, np.uint64)
        parts = defaultdict(set)
        for t in terms:
            if SHORTEST <= len(t):
                raw, slack, half = t.encode(), int(char_bytes(np.frombuffer(t.encode(), np.uint8)).max()), len(t) // 2
                # an edit leaves one half whole, and of the other half its first or its last part
                for ahead, behind in ((half + (len(t) - half) // 2, 0), (half, len(t) - half - (len(t) - half) // 2), (0, len(t) - half // 2), (half // 2, len(t) - half)):
                    a, b = len(t[:ahead].encode()), len(t[len(t) - behind :].encode())
                    parts[a, b, len(raw), slack].add(int(ends_hash(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), a, b)[0]))
        #: bytes at the front, bytes at the end, bytes of the term, bytes of its widest character -> hashes of these ends
        self.parts = {kind: np.sort(np.array(list(found), np.uint64)) for kind, found in parts.items()}
        self.seen: dict[int, tuple[float, int]] = {}

    @staticmethod
    def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(values), bool)
        slot = np.searchsorted(table, values)
        slot[slot == len(table)] = 0
        return table[slot] == values

    def misspelled(self, word: str) -> float:
        """Weight of the strongest term within one edit, 0 if none."""
        return max((self.weights[i] for i in Automaton(word, 1).intersect(self.trie) if len(self.terms[i]) >= SHORTEST and self.terms[i] != word), default=0.0)

    def lookup(self, words: textops.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of matching words, their weights, and whether misspelled."""
        # equal words of a slice are looked up once
        h, once, each = np.unique(words.hashes(), return_index=True, return_inverse=True)
        start, end = words.start[once], words.end[once]
        exact = self._in(h, self.hashes)
        length = end - start
        maybe = np.zeros(len(h), bool)
        view = textops.eights(words.data)
        fit = np.flatnonzero(~exact & (length >= SHORTEST - 1))
        fit = fit[~self._in(h[fit], self.clean)]
        wide = np.ones(len(h), np.int64)
        for least in (2, 3, 4):
            some = np.r_[0, np.cumsum(char_bytes(words.data) >= least)]
            wide[some[end] > some[start]] = least
        for (ahead, behind, whole, slack), known in self.parts.items():
            # one edit changes the length by one character at most
            at = fit[(length[fit] >= max(ahead, behind)) & (np.abs(length[fit] - whole) <= np.maximum(wide[fit], slack))]
            maybe[at[self._in(ends_hash(words.data, start[at], end[at], ahead, behind, view), known)]] = True
        weight = np.zeros(len(h))
        slot = np.searchsorted(self.hashes, h[exact])
        weight[exact] = self.weights[slot]
        todo = np.flatnonzero(maybe)
        if len(self.seen) > 1 << 18:
            self.seen.clear()
        for i in todo.tolist():
            key = int(h[i])
            if key not in self.seen:
                self.seen[key] = self.misspelled(words.data[start[i] : end[i]].tobytes().decode("utf-8", "replace"))
            weight[i] = self.seen[key]
        at = np.flatnonzero(weight[each] > 0)
        return at, weight[each[at]], ~exact[each[at]]


def quotation_marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotation marks in order, their bytes, and kinds: 1 opens, -1 closes, 0 is straight and does either."""
    at, size, kind = [np.flatnonzero(_QUOTES[data])], [1], [0]
    for mark, what in _QUOTE_BYTES.items():
        m = np.frombuffer(mark, np.uint8)
        if len(data) >= len(m):
            hit = np.ones(len(data) - len(m) + 1, bool)
            for j, b in enumerate(m):
                hit &= data[j : j + len(hit)] == b
            at.append(np.flatnonzero(hit))
            size.append(len(m))
            kind.append(what)
    n = [len(x) for x in at]
    at, size, kind = np.concatenate(at), np.repeat(size, n), np.repeat(kind, n)
    order = np.argsort(at, kind="stable")
    return at[order], size[order], kind[order]


def paired(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quotations as (opening, closing) places: marks that follow each other, the first opening, the second closing.

    Straight marks open and close in turn, from the start of each text and line."""
    line = np.searchsorted(np.flatnonzero(data == 0x0A), at)
    row = np.searchsorted(offsets, at, "right")
    straight = np.flatnonzero(kind == 0)
    starts, group = packing.groups(row[straight], line[straight])
    turn = kind.copy()
    turn[straight] = np.where((np.arange(len(straight)) - starts[group] if len(starts) else straight) % 2 == 0, 1, -1)
    both = np.flatnonzero((turn[:-1] == 1) & (turn[1:] == -1) & (row[:-1] == row[1:]))
    return at[both], at[both + 1]


def words_of(part: pa.RecordBatch, column: str) -> tuple[textops.Words, tuple[np.ndarray, np.ndarray]]:
    """Words of a slice, which quotation marks end as blanks do, and the quotations in it."""
    data, offsets = textops.raw(part.column(column))
    at, size, kind = quotation_marks(data)
    plain = data.copy()
    for j in range(3):
        plain[at[size > j] + j] = 0x20
    return textops.Words(plain, offsets, textops.ALNUM_WORD), paired(data, offsets, at, kind)


def features(part: pa.RecordBatch, column: str, lexicon: Lexicon) -> np.ndarray:
    """One row of features per text of the slice."""
    words, marks = words_of(part, column)
    n = part.num_rows
    out = np.zeros((n, N_FEATURES))
    at, weight, wrong = lexicon.lookup(words)
    if not len(at):
        return out
    row = np.searchsorted(words.bounds, at, "right") - 1
    low, high = np.maximum(at - WINDOW, words.bounds[row]), np.minimum(at + WINDOW + 1, words.bounds[row + 1])
    # inside a quotation: the last one that opens before the word closes after it
    opening, closing = marks
    last = np.searchsorted(opening, words.start[at]) - 1
    quoted = (last >= 0) & (np.r_[closing, 0][last] > words.start[at])
    near = np.searchsorted(at, high) - np.searchsorted(at, low)
    h = words.hashes()[at]
    order = np.lexsort((h, row))
    first = np.zeros(len(at), bool)
    starts, _ = packing.groups(row[order], h[order])
    first[order[starts]] = True
    abuse = ~quoted

    def total(mask, value):
        return np.bincount(row[mask], weights=np.broadcast_to(value, at.shape)[mask].astype(float), minlength=n)

    out[:, 0] = np.log1p(total(abuse & ~wrong & first, weight))
    out[:, 1] = np.log1p(total(abuse & ~wrong, 1.0))
    np.maximum.at(out[:, 2], row[abuse & ~wrong], weight[abuse & ~wrong])
    out[:, 3] = np.log1p(total(abuse & wrong & first, weight))
    out[:, 4] = np.log1p(total(abuse & wrong, 1.0))
    np.maximum.at(out[:, 5], row[abuse], np.log(near[abuse]))
    out[:, 6] = np.log1p(total(quoted, weight))
    out[:, 7] = np.sqrt(out[:, 1] / np.maximum(np.log1p(np.diff(words.bounds)), 1))
    return out


class Model:
    """Logistic model over the features; ``rate`` alone where nothing can be learned."""

    def __init__(self, lexicon: Lexicon | None, rate: float):
        self.lexicon, self.rate = lexicon, rate
        self.w, self.b = np.zeros(N_FEATURES), float(np.log(rate / (1 - rate)))
        self.scale = np.ones(N_FEATURES)

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> None:
        if not 0 < y.sum() < len(y):
            return
        self.scale = x.std(axis=0) + 0.1
        z = np.c_[x / self.scale, np.ones(len(x))]
        beta = np.r_[self.w, self.b]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            grad = z.T @ (p - y) + ridge * np.r_[beta[:-1], 0]
            hess = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + ridge * np.diag(np.r_[np.ones(N_FEATURES), 1e-3])
            step = np.linalg.solve(hess, grad)
            beta = beta - step
            if np.abs(step).max() < 1e-6:
                break
        self.w, self.b = beta[:-1], float(beta[-1])
        s = self.logit(x)
        order = np.argsort(s)
        poor, good = np.r_[0, np.cumsum(1 - y[order])] / (len(y) - y.sum()), np.r_[0, np.cumsum(y[order])] / y.sum()
        edge = np.r_[s[order][0] - 1, (s[order][1:] + s[order][:-1]) / 2, s[order][-1] + 1]
        gain = poor - good
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        self.b -= float(edge[best[len(best) // 2]])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x / self.scale) @ self.w + self.b

    def score(self, part: pa.RecordBatch, column: str) -> np.ndarray:
        if self.lexicon is None:
            return np.full(part.num_rows, self.rate)
        return 1 / (1 + np.exp(-np.clip(self.logit(features(part, column, self.lexicon)), -30, 30)))


def _word_counts(rows: DataFrame) -> DataFrame:
    """word, toxic and clean document counts; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts: dict[bytes, list[int]] = {}
        for batch in batches:
            for part in textops.pieces(batch, "_text"):
                words, _ = words_of(part, "_text")
                h = words.hashes()
                toxic = part.column("_y").to_numpy(zero_copy_only=False)
                for i in range(part.num_rows):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    for j in np.unique(h[a:b], return_index=True)[1] + a:
                        counts.setdefault(words.data[words.start[j] : words.end[j]].tobytes(), [0, 0])[1 - int(toxic[i])] += 1
        names = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.decode("utf-8", "replace") for x in names], pa.string()), pa.array([counts[x][0] for x in names], pa.int64()), pa.array([counts[x][1] for x in names], pa.int64())], names=["word", "toxic", "clean"]
        )

    return rows.mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, learning, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Lexicon and model.  ``learning``: condition on ``_id`` for rows to learn from."""
    marks = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where(learning & F.col("_y").isin(0, 1)).groupBy("_id").agg(F.max("_y").alias("_y"))
    n = marks.count()
    share = min(1.0, MAX_LABELLED / max(n, 1))
    few = marks.where(F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(few), "_id")
    rows = packing.written(rows.groupBy("_text", "_y").agg(F.min("_id").alias("_id")), "toxicity-rows")  # copies of a text teach once
    teach = F.pmod(F.xxhash64("_id", F.lit(SEED + 1)), F.lit(3)) > 0
    tally = {(r["t"], r["_y"]): r["c"] for r in rows.groupBy(teach.alias("t"), "_y").agg(F.count(F.lit(1)).alias("c")).collect()}
    n_toxic, n_clean = tally.get((True, 1), 0), tally.get((True, 0), 0)
    positive = sum(c for (_, y), c in tally.items() if y == 1)
    rate = (positive + 1) / (sum(tally.values()) + 2)
    if not n_toxic or not n_clean:
        return Model(None, rate)
    counts = packing.written(_word_counts(rows.where(teach).select("_text", "_y")), "toxicity-words")
    share_toxic = n_toxic / (n_toxic + n_clean)
    all_docs = F.col("toxic") + F.col("clean")
    odds = F.log(((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1)))
    ratio = 2 * (F.col("toxic") * F.log(F.col("toxic") / (all_docs * share_toxic)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (all_docs * (1 - share_toxic)))).otherwise(0.0))
    best = counts.where(F.col("toxic") >= MIN_DOCS).select("word", odds.alias("odds"), ratio.alias("ratio")).where((F.col("odds") >= MIN_ODDS) & (F.col("ratio") >= MIN_RATIO)).orderBy(F.desc("ratio"), "word").limit(MAX_TERMS).collect()
    if not best:
        return Model(None, rate)
    terms, weights = [r["word"] for r in best], [r["odds"] for r in best]
    draft = docs.sparkSession.sparkContext.broadcast(Lexicon(terms, weights, []))

    def near_terms(batches):
        for batch in batches:
            lexicon = draft.value
            for part in textops.pieces(batch, "word"):
                words = textops.Words(*textops.raw(part.column("word")), textops.ALNUM_WORD)
                at, _, wrong = lexicon.lookup(words)
                rows = np.unique(np.searchsorted(words.bounds, at[wrong], "right") - 1)
                yield part.select(["word"]).take(pa.array(rows, pa.int64()))

    # clean words of the bounded sample that one edit turns into a term
    clean = [r["word"] for r in counts.where("clean > 0").select("word").mapInArrow(near_terms, "word string").collect()]
    model = Model(Lexicon(terms, weights, clean), rate)
    held = docs.sparkSession.sparkContext.broadcast(model.lexicon)

    def describe(batches):
        for batch in batches:
            for part in textops.pieces(batch, "_text"):
                yield pa.RecordBatch.from_arrays([pa.array(list(features(part, "_text", held.value)), pa.list_(pa.float64())), part.column("_y")], names=["x", "y"])

    got = rows.where(~teach).select("_text", "_y").mapInArrow(describe, "x array<double>, y int").toArrow()
    model.fit(np.array(got.column("x").combine_chunks().flatten().to_numpy()).reshape(-1, N_FEATURES), got.column("y").to_numpy())
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "_score") -> DataFrame:
    """``docs`` with the score; a column of that name in the input is replaced."""
    docs = docs.drop(name)
    held, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in textops.pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.value.score(part, text), pa.float64())], names=[*names, name])

    return docs.mapInArrow(run, packing.extended(docs, f"{name} double"))
