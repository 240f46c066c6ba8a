"""Per-key results when a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.functions.text import id_upper, strip


def distinct_counts(rows: DataFrame, key, member) -> DataFrame:
    """(key, n): the number of distinct members of every key, with no task bound to one key.

    Two algebraic aggregations. The first is keyed by (key, member), so a hot
    key's members spread over all tasks and repeats are dropped in each task's
    bounded hash table before the shuffle (it spills to sorted runs when full).
    The second counts by key; each task sends one partial count per key, so the
    hottest key costs as many rows as there are tasks. Null or empty keys and
    members name nobody and are left out.
    """
    pairs = rows.select(key.alias("key"), member.alias("member")).where(F.col("key").isNotNull() & F.col("member").isNotNull()).distinct()
    return pairs.groupBy("key").agg(F.count("*").alias("n"))


def review_counts(catalog: DataFrame, reviews: DataFrame) -> DataFrame:
    """(parent_asin, review_count, found_count): each product once, its stated and its real number of reviews.

    Ids compare case and blanks aside; the product's id is given as in the
    catalog, trimmed and in upper case. A product that stands twice with
    different counts keeps both rows. Products without reviews have 0; an
    empty catalog gives no rows, empty reviews give 0 throughout; extra columns
    are never read.
    """
    products = catalog.select(id_upper("parent_asin").alias("parent_asin"), F.col("review_count").cast("long").alias("review_count")).where("parent_asin is not null").distinct()
    counts = distinct_counts(reviews, id_upper(reviews["parent_asin"]), F.nullif(strip(reviews["review_id"]), F.lit("")))
    counts = counts.select(F.col("key").alias("parent_asin"), F.col("n").alias("found_count"))
    return products.join(counts, "parent_asin", "left").withColumn("found_count", F.coalesce("found_count", F.lit(0)))


def wrong_counts(catalog: DataFrame, reviews: DataFrame) -> DataFrame:
    """(parent_asin): products whose non-null review_count is not the number of their distinct reviews."""
    return review_counts(catalog, reviews).where(F.col("review_count").isNotNull() & (F.col("review_count") != F.col("found_count"))).select("parent_asin").distinct()
