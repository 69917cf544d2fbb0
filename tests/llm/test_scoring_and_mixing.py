"""Classifiers, scores, chat windows, URL templates and mixing against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from astrolake.llm import chat_format, pseudo_likelihood, pu_quality, queries, source_mix, textops, toxicity, url_templates

from .conftest import sentence

# toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_automaton_finds_all_terms_within_its_edits():
    rng = random.Random(0)
    terms = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    trie = toxicity.Trie(terms)
    for _ in range(60):
        word = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 8)))
        for edits in (0, 1, 2):
            got = sorted(terms[i] for i in toxicity.Automaton(word, edits).intersect(trie))
            assert got == [t for t in terms if distance(word, t) <= edits]


def test_lexicon_lookup_is_brute_force():
    rng = random.Random(1)
    terms = ["horrid", "wretched", "dolt", "fiend", "é" * 6]
    lexicon = toxicity.Lexicon(terms, [5.0, 4.0, 3.0, 2.0, 6.0], ["friend"])
    words = []
    for _ in range(400):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "x", "q"])
        words.append("".join(w) or "q")
    words += ["friend", "friends", "HORRID"]
    data, offsets = textops.raw(pa.array([" ".join(words)]))
    at, weight, wrong = lexicon.lookup(textops.Words(data, offsets, textops.ALNUM_WORD))
    want = {}
    for i, w in enumerate(x.lower() for x in words):
        if w in terms:
            want[i] = (dict(zip(terms, [5.0, 4.0, 3.0, 2.0, 6.0], strict=True))[w], False)
        elif w != "friend":
            near = [s for t, s in zip(terms, [5.0, 4.0, 3.0, 2.0, 6.0], strict=True) if len(t) >= 5 and distance(w, t) <= 1]
            if near:
                want[i] = (max(near), True)
    assert {int(i): (float(s), bool(x)) for i, s, x in zip(at, weight, wrong, strict=True)} == want


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon(["horrid"], [5.0], [])
    batch = pa.RecordBatch.from_arrays([pa.array(['they said "you horrid" there', "they said you horrid there", "“horrid”", None, ""])], names=["t"])
    x = toxicity.features(batch, "t", lexicon)
    assert x[0, 6] > 0 and x[0, 1] == 0 and x[1, 1] > 0 and x[1, 6] == 0 and x[2, 6] > 0
    assert not x[3:].any()
    said = ['he said "hello" you horrid man she said "bye"', '"' + "word " * 30 + 'horrid"', 'one " mark horrid', 'it is "fine"\nhorrid "thing"', "« horrid » horrid", "“horrid"]
    x = toxicity.features(pa.RecordBatch.from_arrays([pa.array(said)], names=["t"]), "t", lexicon)
    assert [(bool(r[1]), bool(r[6])) for r in x] == [(True, False), (False, True), (True, False), (True, False), (True, True), (True, False)]


@pytest.fixture(scope="module")
def abusive(spark):
    rng = random.Random(2)
    bad, rows, labels = ["horrid", "wretched", "fiends", "dullard"], [(None, "horrid"), (-1, None), (-2, "")], [(-1, 0), (-1, 0), (None, 1)]
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w = rng.choice(bad)
                words.insert(rng.randrange(len(words)), w if rng.random() < 0.7 else w[:2] + "x" + w[3:])
        elif i % 7 == 0:
            words.insert(rng.randrange(len(words)), f'"{rng.choice(bad)}"')
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_on_held_out_rows(abusive, spark):
    docs, labels, truth = abusive
    model = toxicity.train(docs, labels, queries._fold("_id", 5) != 0)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 403 and all(0 <= r["_score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] >= 0 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([(r["_score"] >= 0.5) == truth[r["doc_id"]] for r in held]) >= 0.95
    again = toxicity.scored(docs, toxicity.train(docs, labels, queries._fold("_id", 5) != 0)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    for none in (labels.limit(0), labels.where("toxic = 0")):
        flat = {r["_score"] for r in toxicity.scored(docs, toxicity.train(docs, none, F.lit(True))).collect()}
        assert len(flat) == 1
    assert toxicity.scored(docs.limit(0), model).count() == 0
    # a column of the score's name is replaced, a very long text is scored like its parts' sums ask for, labels of both kinds are toxic
    long = docs.limit(1).select("doc_id", F.expr("repeat('plain words of no harm ', 60000)").alias("text"), F.lit(7.0).alias("_score"), F.lit("x").alias("word"))
    once = toxicity.scored(long, model).collect()
    assert len(once) == 1 and set(once[0].asDict()) == {"doc_id", "text", "_score", "word"} and 0 <= once[0]["_score"] < 0.5
    both = labels.unionByName(labels.where("toxic = 1").withColumn("toxic", F.lit(0)))
    flipped = toxicity.scored(docs, toxicity.train(docs, both, queries._fold("_id", 5) != 0)).collect()
    assert sorted(map(str, flipped)) == sorted(map(str, got))


# quality


def test_quality_on_held_out_rows(spark):
    rng, rows, labels = random.Random(3), [(-1, None), (-2, ""), (None, "a b")], [(-1, 1), (None, 0)]
    for i in range(600):
        good = i % 4 > 0
        text = sentence(rng, rng.randrange(40, 90), 2000).capitalize() + "." if good else rng.choice(["Buy!! NOW!! $$$ ", "||| 123 <> %% "]) * rng.randrange(10, 40)
        rows.append((i, text))
        if i % 2 == 0 or good:
            labels.append((i, int(good)))
    docs, marks, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)
    model = pu_quality.train(docs, marks, queries._fold("_id", 4) != 2)
    got = pu_quality.scored(docs, model).collect()
    assert len(got) == 603 and all(0 <= r["_score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] in truth and r["doc_id"] is not None and r["doc_id"] >= 0 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([(r["_score"] >= pu_quality.CUT) == truth[r["doc_id"]] for r in held]) >= 0.95
    clash = docs.withColumns({"_score": F.lit(1), "doc": F.lit("x"), "_text": F.lit(2)})
    kept = pu_quality.keep_good(clash, marks, queries._fold("_id", 4) != 2)
    assert kept.columns == clash.columns and kept.count() == sum(r["_score"] >= pu_quality.CUT for r in got)
    assert len({r["_score"] for r in pu_quality.scored(docs, pu_quality.train(docs, marks.limit(0), F.lit(True))).collect()}) == 1
    assert pu_quality.scored(docs.limit(0), model).count() == 0


def test_pu_gradient_is_that_of_the_risk():
    """Finite differences of the unbiased risk, where the bracket is positive."""
    rng = np.random.default_rng(0)
    xp, xu, prior = rng.normal(size=(9, 4)), rng.normal(size=(12, 4)), 0.3
    net = pu_quality.Network(xp, xu, prior, hidden=3)
    net.p = [rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=3), np.array(0.5)]

    def risk():
        zp, zu = net._forward(xp)[1], net._forward(xu)[1]
        left = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        assert left > 0
        return prior * np.logaddexp(0, -zp).mean() + left

    for p, g in zip(net.p, net._gradient(xp, xu, prior), strict=True):
        for at in list(np.ndindex(p.shape))[:4]:
            kept, h = float(p[at]), 1e-6
            p[at] = kept + h
            up = risk()
            p[at] = kept - h
            down = risk()
            p[at] = kept
            assert abs((up - down) / (2 * h) - np.asarray(g)[at]) < 1e-5


# language-model scores


def test_pseudo_likelihood_is_the_sum_over_masked_positions(docs, rows, nothing):
    texts = docs.select(F.col("text").alias("t"))
    ranked = pseudo_likelihood.vocabulary_of(texts, 3)
    counts = collections.Counter(w for r in rows for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))))
    hashed = {w: toxicity.word_hash(w) for w in counts}
    best = sorted(counts, key=lambda w: (-counts[w], int(np.uint64(hashed[w]).view(np.int64))))[: pseudo_likelihood.WORDS]
    assert ranked.tolist() == [hashed[w] for w in best]
    net, _ = pseudo_likelihood.train(texts.coalesce(1), ranked, rounds=1)
    number = {hashed[w]: i for i, w in enumerate(best)}
    side, outside = pseudo_likelihood.SIDE, pseudo_likelihood.SIZE
    data, offsets = textops.raw(pa.array(["w1 w2 zz w3", "w5", ""]))
    words = textops.Words(data, offsets, textops.ALNUM_WORD)
    order = np.argsort(ranked)
    ids = pseudo_likelihood.numbers(words, ranked[order], order)
    assert ids.tolist() == [number.get(int(h), pseudo_likelihood.WORDS + int(h % np.uint64(pseudo_likelihood.OTHERS))) for h in words.hashes()]
    around = pseudo_likelihood.surroundings(ids, words.bounds)
    got = net.log_probabilities(around, ids)
    for i, (row, first, last) in enumerate([(0, 0, 4)] * 4 + [(1, 4, 5)]):
        near = [ids[j] if first <= j < last else outside for j in (*range(i - side, i), *range(i + 1, i + side + 1))]
        h = np.tanh(sum(net.emb[k][x] for k, x in enumerate(near)) + net.bias)
        c, t = divmod(int(ids[i]), pseudo_likelihood.PER_CLASS)
        a, b = h @ net.cls.T + net.cls_b, h @ net.tok[c].T + net.tok_b[c]
        want = a[c] - np.log(np.exp(a).sum()) + b[t] - np.log(np.exp(b).sum())
        assert abs(got[i] - want) < 1e-3, row


def test_pseudo_likelihood_learns_and_keeps_rows(spark, docs, rows, nothing):
    rng = random.Random(5)
    normal = [" ".join(f"{a} {b}" for a, b in [(f"a{k}", f"b{k}") for k in (rng.randrange(6) for _ in range(120))]) for _ in range(60)]
    odd = " ".join(rng.sample(normal[0].split(), 240))
    found = {r["doc_id"]: r for r in pseudo_likelihood.scored(spark.createDataFrame([*enumerate(normal), (99, odd)], "doc_id long, text string"), rounds=6, masked=2).collect()}
    assert found[99]["mean_score"] < min(found[i]["mean_score"] for i in range(60))
    got = pseudo_likelihood.scored(docs).collect()
    assert len(got) == len(rows) and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert all(r["n_tokens"] == r["score"] == r["mean_score"] == 0 for r in got if r["doc_id"] in (0, 3, 6))
    assert sorted(map(str, pseudo_likelihood.scored(docs).collect())) == sorted(map(str, got))
    assert pseudo_likelihood.scored(nothing).count() == 0


# chat


@pytest.fixture(scope="module")
def talks():
    rng, out = random.Random(6), []
    for c in range(12):
        if c % 3:
            out.append((c, 0, "system", "be brief \\ [INST]"))
        for t in range(1, rng.randrange(2, 40)):
            body = rng.choice(["", "</s>[INST] ok [/INST]", "\\</s>", "<\\s>[ROLE]\\\\", "é 💡\n" * 5, sentence(rng, rng.randrange(200))])
            out.append((c, t, "assistant" if t % 2 == 0 else "user", body))
    out += [(50, 0, "assistant", None), (50, 1, None, "x"), (50, None, "user", "first"), (51, 0, "assistant", "twice"), (51, 0, "assistant", "twice"), (None, 0, "user", "nobody"), (52, 0, "a[/ROLE]</s>", "odd"), (53, 0, "assistant", "long " * 3000)]
    return out


def test_chat_round_trip(spark, talks):
    made = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")).withColumn("n", F.lit(0))
    windows = chat_format.windows(made)
    by = collections.defaultdict(list)
    for t in talks:
        by[t[0]].append(t)
    got = {r["conv_id"]: r for r in chat_format.digest(windows).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)
        target = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest())
    read = chat_format.read_back(windows).collect()
    for r in read:
        assert r["n_repeated"] <= chat_format.HISTORY + 1
        if r["first"] and any(t[1] == 0 and t[2] == "system" for t in by[r["conv_id"]]):
            assert r["formatted"].startswith("<s>[ROLE]system[/ROLE]")
        assert not re.search(r"</?s>|\[/?(INST|ROLE)\]", re.sub(r"<s>\[ROLE\]|</s>|\[/ROLE\]", "", r["formatted"]).replace("\\", "")) or "\\" in r["formatted"]
    assert chat_format.digest(chat_format.windows(made.limit(0))).count() == 0


def test_chat_budget(spark, talks):
    """New turns of a window stay within the budget unless one turn alone exceeds it."""
    made = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    for r in chat_format.read_back(chat_format.windows(made)).collect():
        sizes = [len(re.findall(r"[^\W_]+|[^\s\w]|_", t["text"])) + 4 for t in r["turns"]]
        assert len(sizes) == 1 or sum(sizes) <= chat_format.BUDGET


def test_chat_history(spark, talks):
    """A window repeats the system turn and just the turns before it that fit; windows are numbered by their first turn."""
    made = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    size = lambda t: len(re.findall(r"[^\W_]+|[^\s\w]|_", t)) + 4
    turn = re.compile(r"(?s)<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>")
    plain = lambda t: re.sub(r"\\(\\?)", r"\1", t)
    by = collections.defaultdict(list)
    for t in sorted(talks, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        by[t[0]].append((t[2] or "", t[3] or ""))
    for history in (0, 2):
        rows, seen = chat_format.windows(made, history=history).collect(), collections.defaultdict(list)
        for r in rows:
            said, first = by[r["conv_id"]], r["first"]
            system = said[0][0] == "system"
            past = [i for i in range(max(first - history, int(system)), first) if sum(size(x[1]) for x in said[i:first]) <= chat_format.HISTORY_TOKENS]
            want = [said[0]] * (system and first > 0) + [said[i] for i in past]
            assert [(plain(a), plain(b)) for a, b in turn.findall(r["formatted"])][: r["n_repeated"]] == want
            seen[r["conv_id"]].append((r["first"], r["window"]))
        assert all([w for _, w in sorted(v)] == list(range(len(v))) for v in seen.values())


# URLs


def whole_url(url):
    m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def brute_templates(shapes, depth=url_templates.DEPTH):
    """(host, shape) -> template from {(host, shape): [n, allow, block]}."""
    node = dict.fromkeys(shapes, "")
    parts = {k: k[1].strip("/").split("/", depth - 1) for k in shapes}
    for level in range(depth):
        children = collections.defaultdict(lambda: [0, 0, 0])
        for k, v in shapes.items():
            if level < len(parts[k]):
                c = children[k[0], node[k], parts[k][level]]
                for i in range(3):
                    c[i] += v[i]
        nodes = collections.defaultdict(list)
        for (h, n, s), v in children.items():
            nodes[h, n].append((s, v))
        name = {}
        for (h, n), kids in nodes.items():
            total = [sum(v[i] for _, v in kids) for i in range(3)]
            for s, v in kids:
                labels, others = v[1] + v[2], total[1] + total[2] - v[1] - v[2]
                name[h, n, s] = re.sub(r"^(\\*[*~])$", r"\\\1", s)
                if len(kids) > url_templates.MAX_CHILDREN and v[0] < url_templates.MIN_SHARE * total[0]:
                    name[h, n, s] = "*"
                elif labels and others:
                    p = (total[2] + 0.5) / (total[1] + total[2] + 1)
                    z = abs(v[2] / labels - (total[2] - v[2]) / others) / math.sqrt(p * (1 - p) * (1 / labels + 1 / others))
                    if z < url_templates.MERGE_Z:
                        name[h, n, s] = "~"
        node = {k: node[k] + ("/" + name[k[0], node[k], parts[k][level]] if level < len(parts[k]) else "") for k in shapes}
    return node


def test_url_verdicts(spark):
    rng, rows = random.Random(7), [(-1, None), (-2, ""), (-3, "no scheme/x"), (-4, "a\nb://EXAMPLE.org/es/x?y#z"), (-5, "http://"), (-6, "http://h?://b"), (-7, "x" * 5000 + "://org/" + "y/" * 3000)]
    hosts = ["example.org", "a.example.org", "WWW.example.ORG", "notexample.org", "shop.com", "com", "shop.net", "Éa.com"]
    for i in range(900):
        path = rng.choice(["/es/", "/en/", "/fr/", "/de/", "/", "//x", "", "/tag/", "/*/", "/~/", "/\\*/"]) + rng.choice(["", f"{rng.randrange(300)}", f"p{rng.randrange(20)}/q{rng.randrange(4)}/r/s/t", "item"])
        rows.append((i, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{path}{rng.choice(['', '?a=/b', '#c'])}"))
    rows += rows[:20]
    df = url_templates.judged(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")), queries.URL_RULES)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = df.collect()
    split, judged = [], []
    for i, u in rows:
        h, p = whole_url(u)
        fits = [(len(w) + len(s), w + s, v) for w, s, v in queries.URL_RULES if (h == w or h.endswith("." + w)) and p.startswith(s)]
        rule = max(fits)[1:] if fits else (None, None)
        split.append((i, h, p, *rule, re.sub("/+", "/", re.sub("[0-9]+", "#", p))))
    shapes = collections.defaultdict(lambda: [0, 0, 0])
    for _, h, _, _, v, s in split:
        c = shapes[h, s]
        c[0] += 1
        c[1] += v == "allow"
        c[2] += v == "block"
    node = brute_templates(shapes)
    allow, block = sum(c[1] for c in shapes.values()), sum(c[2] for c in shapes.values())
    k = url_templates.PRIOR
    base = (block + k / 2) / (allow + block + k)
    by_host, by_node = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    for key, c in shapes.items():
        for table, name in ((by_host, key[0]), (by_node, (key[0], node[key]))):
            table[name][0] += c[1]
            table[name][1] += c[2]
    for i, h, p, r, v, s in split:
        a, b = by_node[h, node[h, s]]
        ha, hb = by_host[h]
        purity = (b + k * (hb + k * base) / (ha + hb + k)) / (a + b + k)
        judged.append((i, h, p, r, v or ("block" if purity > url_templates.REJECT else "allow"), node[h, s], round(purity, 9)))
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["template"], round(r["purity"], 9)) for r in got), key=repr) == sorted(judged, key=repr)
    assert {v for *_, v, _, _ in judged} == {"allow", "block"}
    assert url_templates.judged(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


# mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        left = sum(sizes.values()) - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def test_mix(docs, rows, spark):
    got = source_mix.mix(docs).collect()
    assert len(got) == len(rows)
    source = {(r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))): r[3] for r in rows}
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    targets = brute_targets(sizes)
    for r in got:
        assert abs(r["target"] - targets[source[r["doc_id"], r["size"]]]) < 1e-6 * max(1, r["target"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s]
    assert sorted(map(str, source_mix.mix(docs.repartition(7)).collect())) == sorted(map(str, got))
    whole = source_mix.repeated(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r["copies"] for r in got)
    assert source_mix.mix(docs.limit(0)).count() == 0


def test_pareto_order(spark):
    """Inclusion odds follow the formula: larger documents are taken more often."""
    rows = [(i, "w " * (1 + 9 * (i % 2)), "a") for i in range(2000)] + [(5000 + i, "w", "b") for i in range(20)]
    got = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 800)).where("doc_id < 5000").collect()
    small, large = (np.mean([r["copies"] for r in got if r["size"] == n]) for n in (1, 10))
    assert 0 <= small < large <= 3


def test_inclusion_shares_over_seeds(spark):
    """Over many seeds a document is taken as often as its odds say, the sum of sizes near the target, and never by half a copy."""
    rows = [(i, "w " * (1 + 4 * (i % 3)), "a" if i < 300 else "b") for i in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).cache()
    seeds, copies = range(8), collections.defaultdict(list)
    for seed in seeds:
        got = source_mix.mix(docs, weights=(1, 1), seed=seed).collect()
        for ids in (range(300), range(300, 450)):
            mine = [r for r in got if r["doc_id"] in ids]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 5
        for r in got:
            copies[r["doc_id"] // 300, r["size"]].append(r["copies"])
            whole = r["target"] // r["source_size"]
            assert r["copies"] in (whole, whole + 1)
    for part, rest in ((0, 0.75), (1, 0.5)):
        shares = [np.mean(copies[part, n]) % 1 for n in (1, 5, 9)]
        assert shares[0] < shares[2] + 0.05
        # the words taken keep the share, and the tilt by size is a mild one
        assert abs(np.average(shares, weights=[1, 5, 9]) - rest) < 0.05 and all(abs(x - rest) < 0.25 for x in shares)


def test_conversation_of_control_strings_through_the_query(spark, tmp_path):
    spark.createDataFrame([(7, 0, "user", "hi"), (7, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op2_chat_format(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert set(got) == {-1, 7} and got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(said)
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[7]["loss_chars"] == 0
    read = chat_format.windows(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")).collect()
    # the template's own marks stand once for each turn; those of the texts are all escaped
    assert [r["formatted"].count("<s>[ROLE]") for r in read] == [2] and read[0]["formatted"].count("</s>") == 2 and "[INST]" not in read[0]["formatted"]
