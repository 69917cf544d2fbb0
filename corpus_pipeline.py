"""The corpus pipeline: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

A runner writes every stage's result as Parquet and reads it again as the next one's
documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.llm import decontaminate, jaccard_join, packing, pu_quality, source_mix, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; labels of fold 2 of 4 teach nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return pu_quality.keep_good(docs, labels, F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(4)) != 2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join the smallest doc_id stays."""
    return jaccard_join.keep_one(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of 50 bytes or more that a smaller document has are cut out; n_chars follows."""
    return suffix_dedup.deduplicate(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken for sources weighted 5, 2, 1 in turn: doc_id, size, source_size, target, copies, taken."""
    taken = source_mix.mix(docs)
    return taken.select("doc_id", "size", "source_size", "target", "copies", "taken")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_spans", repeated_spans), ("benchmark_leaks", benchmark_leaks), ("source_weights", source_weights)]

#: SQL cannot express the trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; results between stages are kept in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = packing.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
