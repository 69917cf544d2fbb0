"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; rows of fold 0 of 5 teach nothing."""
    from astrolake.llm import toxicity

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), _fold("_id", 5) != 0)
    return toxicity.scored(docs, model).select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that is made of control strings, formatted and read back."""
    from astrolake.llm import chat_format

    given = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.windows(given.unionByName(more)))


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed conditional log-probabilities of every document's tokens."""
    from astrolake.llm.pseudo_likelihood import scored

    return scored(_read(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingle sets of all documents, joined at a similarity of 0.75, as components."""
    from astrolake.llm.jaccard_join import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"))


#: The rules (host, path, verdict) of the contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL, by rules and by path templates."""
    from astrolake.llm.url_templates import judged

    return judged(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op6_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of every fiftieth vector by cosine."""
    from astrolake.llm.ann_search import neighbours

    return neighbours(_read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document left once 50-byte strings of smaller documents are removed."""
    from astrolake.llm.suffix_dedup import remove_repeats

    found = remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc.doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside ten-word windows of benchmark items."""
    from astrolake.llm.decontaminate import contaminated_words

    found = contaminated_words(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc.doc_id",
        "n_words",
        F.col("hit_words").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("hit_words") > 0).alias("contaminated"),
    )


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows of fold 2 of 4 teach nothing."""
    from astrolake.llm import pu_quality

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = pu_quality.train(docs, _read(spark, sf_dir, "labels"), _fold("_id", 4) != 2)
    return pu_quality.scored(docs, model).select("doc_id", (_fold("doc_id", 4) == 2).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= pu_quality.CUT).cast("int").alias("predicted"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document for sources weighted 5, 2, 1 in turn."""
    from astrolake.llm import source_mix

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return source_mix.mix(docs).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle forms of every document, and the texts rebuilt from them."""
    from astrolake.llm import fill_middle

    made = fill_middle.transformed(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc.doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors under eight codebooks of sixteen entries, refined six times."""
    from astrolake.llm import packing, vector_codes

    given = _read(spark, sf_dir, "embeddings")
    books = vector_codes.train(given.select("vec_id", "embedding"))
    rows = vector_codes.encoded(given.select("vec_id", "embedding", "label"), books)
    rows = packing.written(rows.select("doc.vec_id", "doc.label", vector_codes.code_text(F.col("code")).alias("code"), "error", "codebooks_sha256"), "codes")
    return vector_codes.with_group_error(rows, "label").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty largest integer inner products of every twentieth vector."""
    from astrolake.llm.pivot_search import largest_products

    return largest_products(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20).select("query_id", "rank", "vec_id", "score")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_chat_format, op3_pseudo_likelihood, op4_jaccard_join, op5_url_templates, op6_projection_ann, op7_suffix_dedup, op8_decontamination, op9_pu_quality, op10_source_mix, op11_fill_middle, op12_vector_codes, op13_pivot_search)}

from astrolake.llm.sql import ORACLE_SQL  # noqa: E402, F401
