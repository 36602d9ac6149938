"""Queries over the sample tables for the operators of this package, with SQL where SQL can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import best_fit, bpe, hard_negatives, hash_ring, hidden_markov, line_dedup, multiset_hash, ordinal, pivot_search, risk_rules, simhash, turn_repair, url_graph

# Fixed values: (verdict, host, path)
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 for low quality, 1 for good but toxic, 2 for good texts."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return table(spark, sf_dir, "labels").select("doc_id", grade.cast("int").alias("grade")).where("grade is not null")


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", (F.col("quality") == 1).alias("good"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"), F.coalesce(s["first_doc_id"].cast("string"), F.lit("-"))))
    return done.select("doc_id", F.size("removed").cast("bigint").alias("n_removed"), F.array_join(spans, ",").alias("removed"), "text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = risk_rules.apply_rules(table(spark, sf_dir, "documents"), good(spark, sf_dir), ["doc_id", "lang"])
    of = lambda name: F.col(f"{risk_rules.HELD}.{name}").alias(name)
    return done.select("row.doc_id", *map(of, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.shared_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_ring.assign_shards(table(spark, sf_dir, "documents"))


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_documents(table(spark, sf_dir, "documents"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"))


def op9_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ordinal.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), grades(spark, sf_dir))
    return done.select("row.doc_id", "expected_grade", "top_probability", "kept")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_conversations(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_simhash, op3_line_dedup, op4_quality_rules, op5_bpe, op6_hash_ring, op7_hidden_markov, op8_best_fit, op9_multiset_hash, op10_ordinal, op11_turn_repair, op12_hard_negatives,
        op13_pivot_search,
    )
}
# vectors as integers; rows with nulls or non-finite components take no part. Sums of such products are exact in doubles.
SQL_VECTORS = """
{name} AS (SELECT vec_id, {label}, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))"""

ORACLES: dict[str, str] = {
    "op12_hard_negatives": f"""
WITH {SQL_VECTORS.format(name="moved", scale=256, label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")},
usable AS (SELECT * FROM moved WHERE label IS NOT NULL),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) <= 5""",
    "op13_pivot_search": f"""
WITH {SQL_VECTORS.format(name="usable", scale=64, label="label")},
scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
}
