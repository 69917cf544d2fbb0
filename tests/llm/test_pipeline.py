"""Every stage of the pipeline on the result of the one before, against brute force."""

import hashlib
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from astrolake.llm import pu_quality, queries

from .test_search_and_dedup import brute_components, brute_hits, brute_removed, words

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    ids = sorted({r[0] for r in rows if r[0] is not None})
    spark.createDataFrame([(i, int(n % 5 > 0), 0) for n, i in enumerate(ids)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    long = [r[1] for r in rows if r[1] and len(words(r[1])) > 100]
    spark.createDataFrame([(1, " ".join(long[0].split()[:14])), (2, None), (3, "no such words here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, docs, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_spans", "benchmark_leaks", "source_weights"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in now.select("doc_id", "text").collect()]
        after = stage(spark, now, folder)
        if name != "source_weights":
            assert after.columns == docs.columns
        after.write.parquet(f"{folder}/stage{i}")
        now = spark.read.parquet(f"{folder}/stage{i}")
        got = now.collect()
        if name == "quality":
            model = pu_quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), queries._fold("_id", 4) != 2)
            want = pu_quality.scored(docs.select("doc_id", "text"), model).where(F.col("_score") >= pu_quality.CUT).collect()
            assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(((r["doc_id"], r["text"]) for r in want), key=repr)
        elif name == "near_duplicates":
            assert sorted((r["doc_id"] for r in got), key=repr) == sorted((i for i, _, c in brute_components(before) if i is None or i == c), key=repr)
        elif name == "repeated_spans":
            empty = hashlib.sha256(b"").hexdigest()
            # documents of which nothing is left go, those that had no text stay
            want = sorted(((x[0], x[4]) for x in brute_removed(before) if x[4] != empty or x[1] == 0), key=repr)
            whole = sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got), key=repr)
            assert whole == want and len(whole) > 10 and all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in got)
        elif name == "benchmark_leaks":
            items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert sorted((r["doc_id"] for r in got), key=repr) == sorted((x[0] for x in brute_hits(before, items) if not x[2]), key=repr)
        else:
            assert set(now.columns) >= {"doc_id", "size", "target", "taken"}
            assert sorted(((r["doc_id"], r["size"]) for r in got), key=repr) == sorted(((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in before), key=repr)
            for target in {r["target"] for r in got}:
                mine = [r for r in got if r["target"] == target]
                assert abs(sum(r["taken"] for r in mine) - target * len({r["source_size"] for r in mine})) <= max(r["size"] for r in mine) * len({r["source_size"] for r in mine})
            assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in got)


def test_run_is_the_stages_in_order(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.read.parquet(f"{folder}/stage4").select(got.columns).collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["op8_decontamination", "op10_source_mix"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, DATA)
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    assert sorted(tuple(plain(v) for v in r) for r in cursor.fetchall()) == sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
