import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, node long, bucket string, `left` string"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Small documents with copies, near copies, shared passages, nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(4)
    base, passage = sentence(rng, 60), sentence(rng, 40)
    texts = [None, "", "   \n", "one two three", "ONE Two\tthree", base, base, base.upper(), "é" * 30 + " ß" * 20, "é" * 30 + " ß" * 20 + "x"]
    for i in range(25):
        words = base.split()
        words[rng.randrange(60)] = f"edit{i}"
        texts.append(" ".join(words))
    for i in range(20):
        texts.append(sentence(rng, 5 + i) + " " + passage + " " + sentence(rng, 3 * i))
    texts += [sentence(rng, n) for n in (1, 4, 5, 9, 10, 11, 300)]
    texts += ["ab " * 4000, "ab " * 4000 + "tail", "x" * 120, "y" + "x" * 119, sentence(rng, 6000, 5000)]
    out = [(i * 3, t, "en", f"s{i % 4}" if i % 9 else None, None if t is None else len(t), 1, "b", "l") for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, base, None, None, None, None, None, None), (7, passage, "en", "s1", 5, 0, "", "")]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, KINDS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], KINDS)
