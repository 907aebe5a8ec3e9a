"""The queries of this subpackage: opN_<name>(spark, sf_dir), and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import scan
from tideline.llm import embedding_dedup, html_extraction, licenses, mixing, oracles, ordinal, packing, permutation_index
from tideline.llm.simhash_dedup import near_duplicates
from tideline.llm.substring_dedup import remove_repeats


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine; executors have the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordinal.quality(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.col("expected").alias("expected_grade"), F.col("tail").alias("p_good"), F.col("decided").alias("kept"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(scan(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(scan(spark, sf_dir, "documents"))
    taken = F.col("passes") * F.col("size") + F.col("extra")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(scan(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(scan(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack_documents(scan(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(scan(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordinal.toxicity(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.col("expected").alias("expected_severity"), F.col("tail").alias("p_toxic"), F.col("decided").alias("toxic"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(scan(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_permutation_index": op3_permutation_index,
    "op4_mixing": op4_mixing,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_packing": op7_packing,
    "op8_licenses": op8_licenses,
    "op9_toxicity": op9_toxicity,
    "op10_embedding_dedup": op10_embedding_dedup,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op4_mixing": oracles.MIXING,
    "op10_embedding_dedup": oracles.EMBEDDING_DEDUP,
}
