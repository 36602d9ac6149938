"""A pipeline over ``documents``: classifier, quality rules, near-duplicates, repeated lines, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import best_fit, line_dedup, ordinal, queries, risk_rules, wide_simhash
from driftgauge.llm.storage import stored
from driftgauge.llm.text import whole

# SQL can express neither the classifier nor the fingerprints
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably of the top grade."""
    done = ordinal.classify(docs, queries.grades(spark, sf_dir))
    return done.where("kept").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language."""
    done = risk_rules.apply_rules(docs, queries.good(spark, sf_dir), docs.columns)
    return done.where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    A document is a doc_id with a text; a repeated row of it stays beside it. Null ids come last and stay only where a group has no other.
    """
    first = wide_simhash.similar_documents(docs).where("first").select("doc_id", "text_hash").distinct()
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(whole(F.col("text"))).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    return packed.join(first, same, "left_semi").select("row.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has."""
    return line_dedup.drop_repeated_lines(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the tokens of each document go."""
    return best_fit.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("repeated_lines", repeated_lines), ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
