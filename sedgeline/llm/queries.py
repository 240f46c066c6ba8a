"""Queries of the training-data operators: name -> (spark, folder) -> DataFrame, each over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.llm import bpe, components, leakage, neardup, overlap, sentences, stable, targets, topn
from sedgeline.session import table

#: Where the public vocabulary lies; a parameter, never part of this repository.
VOCABULARY = os.environ.get("BYTE_BPE_PATH", "/opt/tokenizers/byte_bpe_50k.json")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return targets.shortfalls(table(spark, d, "aspect_sampling"), table(spark, d, "sampling_targets"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return targets.report(table(spark, d, "aspect_sampling"), table(spark, d, "sampling_targets"))


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return targets.sample(table(spark, d, "aspect_sampling"), table(spark, d, "sampling_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.all_pairs(neardup.review_texts(table(spark, d, "error_analysis")))
    return pairs.select(F.col("id_1").alias("review_id_1"), F.col("id_2").alias("review_id_2"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(neardup.review_texts(table(spark, d, "error_analysis"))).withColumnRenamed("id", "review_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return stable.unreliable(table(spark, d, "aspect_sampling"))


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return stable.frozen_sample(table(spark, d, "aspect_sampling"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_mentions(table(spark, d, "aspect_marts")).select("parent_asin", "aspect_id", "review_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.torn(table(spark, d, "sentiment"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    return components.assign_splits(table(spark, d, "sentiment"), table(spark, d, "split_targets"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return components.split_report(p6_splits(spark, d), table(spark, d, "split_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "sentiment"), table(spark, d, "error_analysis")).select("review_id").distinct()


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_counts(table(spark, d, "sentiment"), table(spark, d, "error_analysis"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(table(spark, d, "documents"), VOCABULARY)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_sample, p2_found, p2_groups, p3_found, p3_sample, p4_found, p6_found, p6_splits, p6_report, p7_found, p7_counts, p8_ids, p9_found, p9_leaks, p10_found)}
