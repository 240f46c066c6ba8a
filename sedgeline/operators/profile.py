"""Profiles and distributions of a review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.functions.text import word_count


def dataset_profile(reviews: DataFrame) -> DataFrame:
    """AG1: one row of counts, exact distinct counts, time span and exact length quantiles (in thousandths)."""
    n = F.length("text")
    q = F.percentile(n, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    one = reviews.agg(
        F.count("*").alias("reviews"),
        F.count_distinct("asin").alias("asins"),
        F.count_distinct("parent_asin").alias("parents"),
        F.count_distinct("user_id").alias("users"),
        F.unix_millis(F.min("ts")).alias("first_ms"),
        F.unix_millis(F.max("ts")).alias("last_ms"),
        F.count_if("verified").alias("verified"),
        F.sum(F.coalesce("helpful", F.lit(0))).cast("long").alias("helpful"),
        F.count_if(F.col("user_id").isNull()).alias("null_users"),
        F.sum(n).cast("long").alias("characters"),
        q.alias("q"),
    )
    milli = lambda i: F.floor(F.col("q")[i] * 1000 + 0.5).cast("long")
    return one.select("*", milli(0).alias("length_p50"), milli(1).alias("length_p90"), milli(2).alias("length_p99")).drop("q")


def distribution(df: DataFrame, value: Column, name: str) -> DataFrame:
    """AG2, AG40: (value, n, percent of all); the total is one row, joined as a scalar."""
    by = df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("__all"))
    return by.crossJoin(F.broadcast(total)).withColumn("percent", 100.0 * F.col("n") / F.col("__all")).drop("__all")


def length_bucket(words: Column) -> Column:
    """PRJ10 with the short class of the population profile."""
    return F.when(words < 5, "too_short_1_4").when(words <= 40, "short_5_40").when(words <= 120, "medium_41_120").otherwise("long_121_plus")


def rating_group(rating: Column) -> Column:
    """PRJ10: low_1_2, mid_3, high_4_5; anything else is null."""
    return F.when(rating.between(1, 2), "low_1_2").when(rating == 3, "mid_3").when(rating.between(4, 5), "high_4_5")


def sentiment_label(rating: Column) -> Column:
    """PRJ9, the strict form: a rating outside 1..5 is an error."""
    return F.when(rating.isin(1, 2), "negative").when(rating == 3, "neutral").when(rating.isin(4, 5), "positive").otherwise(F.raise_error(F.concat(F.lit("no sentiment for rating "), F.coalesce(rating.cast("string"), F.lit("null")))))


def attention_label(rating: Column) -> Column:
    """PRJ8: 1-3 needs attention, 4-5 satisfied; anything else is an error."""
    return F.when(rating.isin(1, 2, 3), "needs_attention").when(rating.isin(4, 5), "satisfied").otherwise(F.raise_error(F.concat(F.lit("no attention class for rating "), F.coalesce(rating.cast("string"), F.lit("null")))))


def length_buckets(reviews: DataFrame) -> DataFrame:
    """AG3."""
    return distribution(reviews, length_bucket(word_count("text")), "length_bucket")


def rating_by_year(reviews: DataFrame) -> DataFrame:
    """AG12, AG42: the crosstab of year and rating as shares of the year, by a pivot over known ratings."""
    wide = reviews.groupBy("year").pivot("rating", [1, 2, 3, 4, 5]).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(str(i)) for i in range(2, 6)), F.col("1"))
    return wide.select(F.col("year").cast("long").alias("year"), *[F.try_divide(F.col(str(i)).cast("double"), total).alias(f"share_{i}") for i in range(1, 6)])


def helpful_by_rating(reviews: DataFrame) -> DataFrame:
    """AG12: counters of the exploratory scan, exact instead of sampled."""
    return reviews.groupBy("rating").agg(F.count("*").alias("reviews"), F.count_if("verified").alias("verified"), F.sum("helpful").cast("long").alias("helpful"), F.sum(F.length("text")).cast("long").alias("characters"), F.max("helpful").cast("long").alias("most_helpful"))
