"""A corpus pipeline out of the training-data operators.

documents -> quality -> exact dedup -> near dedup -> mixing -> packing. Each stage works on what its predecessor
kept, is written as Parquet and read again; all but the last return the columns of documents.

Defined results, for every stage: null or empty texts and null columns do not fail; a row without an id cannot be
named by a decision and stays, unless quality rejects it; rows that repeat id and text become one in exact
dedup, and rows that repeat an id with other texts stay in near dedup as long as one of them is to stay; an empty table gives an empty table; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import exact_dedup, mixing, near_dedup, packing, quality
from tidewire.llm._base import ascii_lower, table


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _rows(docs: DataFrame, **keys) -> DataFrame:
    """The rows as one struct beside key columns, so that no name of theirs can clash with a decision's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject."""
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5))
    known = _labels(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("label")).where(fold != 0)
    model = quality.train(docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("body")), known)
    return quality.keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    decided = table(exact_dedup.deduplicate(docs), "exact-decisions")
    digest = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    rows = _rows(docs, id=F.col("doc_id"), sha=digest)
    gone = decided.where(~F.col("kept")).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).distinct()
    n = decided.count()
    left = rows.join(table(gone, "exact-gone", rows=n), ["id", "sha"], "left_anti")
    again = table(decided.where("kept and doc_id is not null and group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")), "exact-again", rows=n)
    if not again.isEmpty():
        once = left.join(again, ["id", "sha"], "left_semi").dropDuplicates(["id", "sha"])
        left = left.join(again, ["id", "sha"], "left_anti").unionByName(once)
    return left.select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, on five-word shingles."""
    decided = near_dedup.near_dedup(docs)
    # Rows of one id are decided apart, but named by it: they go where none of them is to stay.
    named = decided.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.bool_or("kept").alias("kept"))
    gone = table(named.where(~F.col("kept")).select("id"), "near-gone", rows=docs.count())
    return _rows(docs, id=F.col("doc_id")).join(gone, "id", "left_anti").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    return mixing.apply(docs, mixing.label_domains(_labels(spark, sf_dir)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality_filter), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packed)]

#: A trained classifier, near duplicates and packing are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
