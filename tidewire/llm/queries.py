"""The queries of the training-data operators and the SQL that DuckDB can hold against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import embeddings, exact_dedup, licenses, lm, mixing, near_dedup, packing, quality, sharding, toxicity
from tidewire.llm._base import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents; the path of a document is /source/lang/doc_id."""
    path = F.concat_ws("/", F.lit(""), "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(read(spark, sf_dir, "documents"), path=path)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles."""
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"), shingle=2)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target shares of clean, junk and toxic text."""
    return mixing.mix(read(spark, sf_dir, "documents"), mixing.label_domains(read(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document, by its id."""
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id stays."""
    return exact_dedup.deduplicate(read(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 likelihood of all documents."""
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate groups of all embeddings."""
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_near_dedup": op2_near_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_packing": op4_packing,
    "op5_sharding": op5_sharding,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM t""",
}
