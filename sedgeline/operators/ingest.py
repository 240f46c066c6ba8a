"""Raw reviews to canonical reviews: coercion, cleaning, drop reasons, deduplication, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.functions.text import clean_text

#: Epoch milliseconds that a timestamp can hold.
LEAST_MS, MOST_MS = -9_223_372_036_855, 9_223_372_036_854
MOST_VOTES = 2_147_483_647

#: Every raw column as text, so that values of the wrong type survive to be counted.
RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("rating", "title", "text", "asin", "parent_asin", "user_id", "timestamp", "helpful_vote", "verified_purchase")])


def bounded_integer(x: Column, low: int, high: int) -> Column:
    """PRJ3: the number if it is whole and within the bounds, else null."""
    n = x.try_cast("decimal(38,6)")
    return F.when((n == F.floor(n)) & n.between(low, high), n.cast("long"))


def was_invalid(raw: Column, value: Column) -> Column:
    """Whether a value was given and could not be used."""
    return raw.isNotNull() & value.isNull()


def in_window(ts: Column, first_day: str, last_day: str) -> Column:
    """PRJ4: within the days from first to last, both included."""
    return (ts >= F.lit(first_day).cast("timestamp")) & (ts < F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp"))


def drop_reason(rating: Column, ts: Column, asin: Column, parent: Column, text: Column, first_day: str, last_day: str) -> Column:
    """PRJ2: the first failing check in fixed order, null for a valid row."""
    return (
        F.when(~F.coalesce(rating.isin(1.0, 2.0, 3.0, 4.0, 5.0), F.lit(False)), "invalid_rating")
        .when(ts.isNull(), "invalid_timestamp")
        .when(~in_window(ts, first_day, last_day), "outside_window")
        .when(F.coalesce(F.trim(asin), F.lit("")) == "", "missing_asin")
        .when(F.coalesce(F.trim(parent), F.lit("")) == "", "missing_parent_asin")
        .when(F.coalesce(text, F.lit("")) == "", "empty_review_text")
    )


def flag(x: Column) -> Column:
    """PRJ5: true and false only; anything else is null."""
    low = F.lower(x.cast("string"))
    return F.when(low.isin("true", "false"), low == "true")


def review_id(version: str, index: Column) -> Column:
    """TX3: version:review:number of at least nine digits."""
    return F.concat(F.lit(f"{version}:review:"), F.when(index < 1_000_000_000, F.lpad(index.cast("string"), 9, "0")).otherwise(index.cast("string")))


def transform(raw: DataFrame, version: str, category: str, first_day: str, last_day: str) -> DataFrame:
    """PRJ1: raw rows with ``source_record_index`` to typed rows with ``drop_reason`` and invalid flags.

    Null text is empty; helpful_vote out of bounds and a verified flag other than true or
    false become null and are flagged. No row is dropped here, so counts reconcile.
    """
    rating = F.col("rating").try_cast("float")
    ms = bounded_integer(F.col("timestamp"), LEAST_MS, MOST_MS)
    votes = bounded_integer(F.col("helpful_vote"), 0, MOST_VOTES)
    verified = flag(F.col("verified_purchase"))
    title, body = clean_text("title"), clean_text("text")
    out = raw.select(
        review_id(version, F.col("source_record_index")).alias("review_id"),
        F.lit(version).alias("dataset_version"),
        F.lit(category).alias("dataset_category"),
        "source_record_index",
        F.trim("asin").alias("asin"),
        F.trim("parent_asin").alias("parent_asin"),
        rating.alias("rating"),
        title.alias("review_title"),
        body.alias("review_body"),
        F.trim(F.concat_ws(" ", title, body)).alias("review_text"),
        F.timestamp_millis(ms).alias("review_timestamp"),
        ms.alias("source_timestamp_ms"),
        "user_id",
        verified.alias("verified_purchase"),
        votes.cast("int").alias("helpful_vote"),
        was_invalid(F.col("helpful_vote"), votes).alias("invalid_helpful_vote"),
        was_invalid(F.col("verified_purchase"), verified).alias("invalid_verified_purchase"),
    )
    return out.withColumn("drop_reason", drop_reason(F.col("rating"), F.col("review_timestamp"), F.col("asin"), F.col("parent_asin"), F.col("review_text"), first_day, last_day))


DEDUP_KEY = ("user_id", "asin", "rating", "review_timestamp", "review_text")


def deduplicate(reviews: DataFrame, order: tuple[str, ...] = ("source_record_index", "loaded_at", "review_id")) -> DataFrame:
    """WIN1: the first record of every (user, asin, rating, time, text); a null user is a key like any other.

    The text enters the key as its md5, so that it crosses the shuffle only where the query reads it.
    """
    keyed = reviews.withColumn("__text", F.md5("review_text"))
    w = Window.partitionBy(*DEDUP_KEY[:-1], "__text").orderBy(*[c for c in order if c in reviews.columns])
    return keyed.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__text")


def quality(transformed: DataFrame) -> DataFrame:
    """(measure, n): input, valid, each drop reason, duplicates, output, invalid optional values; input = drops + duplicates + output."""
    valid = transformed.where("drop_reason is null")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    drops = transformed.where("drop_reason is not null").groupBy(F.concat(F.lit("drop:"), F.col("drop_reason")).alias("measure")).agg(F.count("*").alias("n"))
    kept = valid.select(*DEDUP_KEY).distinct()
    invalid = transformed.select(F.explode(F.array(F.when(F.col("invalid_helpful_vote"), "invalid:helpful_vote"), F.when(F.col("invalid_verified_purchase"), "invalid:verified_purchase"))).alias("measure")).where("measure is not null").groupBy("measure").agg(F.count("*").alias("n"))
    return one(transformed, "input").unionByName(one(valid, "valid")).unionByName(one(kept, "output")).unionByName(drops).unionByName(invalid)


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ19: (column_name, nulls) in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "nulls")


def same_schema(df: DataFrame, schema: T.StructType) -> None:
    """Names and types must be those of ``schema``, in any order; raises with what differs."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in schema}
    wrong = {n: (have.get(n), want.get(n)) for n in have.keys() | want.keys() if have.get(n) != want.get(n)}
    if wrong:
        raise ValueError(f"schema differs: {wrong}")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself, once its keys are known to be non-null and unique; raises with an example otherwise."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"key {keys} is null or repeats: {bad[0].asDict()}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """JN12-13: a join that fails where the right key (and the left with ``one_to_one``) repeats."""
    unique(right, on)
    if one_to_one:
        unique(left, on)
    return left.join(right, on, how)
