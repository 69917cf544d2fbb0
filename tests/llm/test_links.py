"""The Jaccard join counts every link between different texts."""

import random

import pytest

from astrolake.llm import jaccard_join
from tests.llm.test_search_and_dedup import shingles


def linked_texts(rows):
    sets = {frozenset(shingles(t)) for _, t in rows} - {frozenset()}
    return {s: sum(s != o and 100 * len(s & o) >= 75 * len(s | o) for o in sets) for s in sets}


@pytest.mark.parametrize("options", [{}, {"count_block": 30}, {"block": 4, "all_pairs": 3}])
def test_all_links_are_counted(spark, options):
    rng = random.Random(9)
    base, rows = [f"w{rng.randrange(400)}" for _ in range(200)], []
    for i in range(100):
        words = list(base)
        for j in range(1 + i % 4):
            words[rng.randrange(200)] = f"edit{i}x{j}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[i][1]) for i in range(5)] + [(300, "alone in this corpus"), (301, ""), (302, None)]
    want = linked_texts(rows)
    got = {r["doc_id"]: r["n_verified"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options).collect()}
    assert max(want.values()) > 50
    assert got == {i: want.get(frozenset(shingles(t)), 0) for i, t in rows}
