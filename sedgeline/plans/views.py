"""The tables as the core operators read them, and the same views for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.operators import aspects, catalog, ingest
from sedgeline.session import table


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """Canonical reviews: deduplicated, product ids in comparable form."""
    r = ingest.deduplicate(table(spark, d, "reviews"))
    return r.select("review_id", F.trim("asin").alias("asin"), F.upper(F.trim("parent_asin")).alias("parent_asin"), F.col("rating").cast("int").alias("rating"), F.col("review_timestamp").alias("ts"), F.year("review_timestamp").alias("year"), F.nullif(F.trim("user_id"), F.lit("")).alias("user_id"), F.coalesce("verified_purchase", F.lit(False)).alias("verified"), F.coalesce("helpful_vote", F.lit(0)).alias("helpful"), F.col("review_text").alias("text"))


def products(spark: SparkSession, d: str) -> DataFrame:
    return catalog.products(table(spark, d, "product_catalog"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return aspects.latest(table(spark, d, "aspect_marts"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The sentiment manifest with one row per review and comparable splits."""
    s = table(spark, d, "sentiment")
    split = F.nullif(F.regexp_replace(F.lower(F.trim("split_name")), "-", "_"), F.lit(""))
    return s.select("review_id", split.alias("split_name"), "sentiment_label", F.col("rating").cast("int").alias("rating"), F.upper(F.trim("parent_asin")).alias("parent_asin"), F.nullif(F.upper(F.trim("user_id")), F.lit("")).alias("user_id")).groupBy("review_id").agg(*[F.max(c).alias(c) for c in ("split_name", "sentiment_label", "rating", "parent_asin", "user_id")])


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with one row per review."""
    e = table(spark, d, "error_analysis")
    cols = ["sentiment_label", "predicted_label", "model_score", "score_negative", "score_neutral", "score_positive", "token_count", "rating", "review_text", "parent_asin"]
    return e.groupBy("review_id").agg(F.min(F.struct(*cols)).alias("x")).select("review_id", "x.*").withColumn("parent_asin", F.upper(F.trim("parent_asin"))).withColumn("rating", F.col("rating").cast("int"))


REVIEWS = """r0 AS (SELECT *, row_number() OVER (PARTITION BY user_id, asin, rating, review_timestamp, review_text ORDER BY source_record_index, loaded_at, review_id) AS rn FROM reviews),
rev AS (SELECT review_id, trim(asin) AS asin, upper(trim(parent_asin)) AS parent_asin, CAST(rating AS INTEGER) AS rating, review_timestamp AS ts, year(review_timestamp AT TIME ZONE 'UTC') AS year,
  strftime(review_timestamp AT TIME ZONE 'UTC', '%Y-%m') AS month, nullif(trim(user_id), '') AS user_id, coalesce(verified_purchase, false) AS verified, coalesce(helpful_vote, 0) AS helpful, review_text AS text FROM r0 WHERE rn = 1)"""
PRODUCTS = """p0 AS (SELECT * REPLACE (upper(trim(parent_asin)) AS parent_asin), row_number() OVER (PARTITION BY upper(trim(parent_asin)) ORDER BY source_record_index, product_title) AS rn FROM product_catalog WHERE trim(parent_asin) <> ''),
prod AS (SELECT * FROM p0 WHERE rn = 1)"""
MENTIONS = """m0 AS (SELECT review_id, upper(trim(parent_asin)) AS parent_asin, lower(trim(aspect_id)) AS aspect_id, CAST(rating AS INTEGER) AS rating, review_timestamp AS ts, strftime(review_timestamp AT TIME ZONE 'UTC', '%Y-%m') AS month, coalesce(helpful_vote, 0) AS helpful,
  CAST(aspect_probability AS DOUBLE) AS probability, lower(trim(aspect_sentiment)) AS sentiment, aspect_sentiment_score AS score, prediction_sources_json AS sources, evidence_json AS evidence, scored_at FROM aspect_marts WHERE review_id IS NOT NULL AND trim(aspect_id) <> ''),
m1 AS (SELECT *, row_number() OVER (PARTITION BY review_id, aspect_id ORDER BY scored_at DESC NULLS LAST, parent_asin DESC NULLS LAST, rating DESC NULLS LAST, ts DESC NULLS LAST, helpful DESC, probability DESC NULLS LAST, sentiment DESC NULLS LAST, score DESC NULLS LAST, sources DESC NULLS LAST, evidence DESC NULLS LAST) AS rn FROM m0),
men AS (SELECT * FROM m1 WHERE rn = 1)"""
MANIFEST = """man AS (SELECT review_id, max(nullif(replace(lower(trim(split_name)), '-', '_'), '')) AS split_name, max(sentiment_label) AS sentiment_label, max(CAST(rating AS INTEGER)) AS rating, max(upper(trim(parent_asin))) AS parent_asin, max(nullif(upper(trim(user_id)), '')) AS user_id FROM sentiment GROUP BY review_id)"""
PREDICTIONS = """e0 AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY sentiment_label NULLS FIRST, predicted_label NULLS FIRST, model_score NULLS FIRST) AS rn FROM error_analysis),
pred AS (SELECT * REPLACE (upper(trim(parent_asin)) AS parent_asin, CAST(rating AS INTEGER) AS rating) FROM e0 WHERE rn = 1)"""
COUNTERS = """count(*) AS mentions, CAST(sum(rating) AS BIGINT) AS rating_sum, count(*) FILTER (WHERE rating <= 3) AS needs_attention, count(*) FILTER (WHERE rating >= 4) AS satisfied,
count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sources LIKE '%"alias"%') AS alias_evidence"""
