"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and reads
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import mixing, ordinal, packing, simhash_dedup, substring_dedup
from tideline.llm.common import parallelism, scan, shared_folder
from tideline.llm.queries import tokenizer_path
from tideline.store.files import Files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return ordinal.good_documents(docs, scan(spark, sf_dir, "labels"), scan(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that SimHash links."""
    return simhash_dedup.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages that an earlier document holds; documents of which nothing is left go."""
    own = [c for c in ("n_words", "n_removed", "kept_sha256") if c in docs.columns]
    rows = substring_dedup.remove_repeats(docs.select("*", *(F.col(c).alias(f"own {c}") for c in own))).where("n_removed < n_words OR n_words = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*(F.col(f"own {c}").alias(c) if c in own else c for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's share, repeating or cutting documents, shard by shard in shuffled order."""
    levels = max(1, parallelism(spark).bit_length())
    rows = mixing.mixed_documents(docs.select("*", *(F.col(c).alias(f"own {c}") for c in ("shard", "shuffle_key") if c in docs.columns)), levels=levels)
    rows = rows.repartition(1 << levels, "shard").sortWithinPartitions("shard", "shuffle_key").withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*(F.col(f"own {c}").alias(c) if f"own {c}" in rows.columns else c for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences: one row a piece."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("simhash_dedup", near_duplicates),
    ("substring_dedup", repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express neither the fitted classifier nor the hashes and ids, so tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    files, before = Files(spark, home), f"{home}/none"  # a stage's output goes when the next one's is written
    for k, (name, stage) in enumerate(STAGES):
        path = f"{home}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        files.delete(before)
        before = path
    return docs
