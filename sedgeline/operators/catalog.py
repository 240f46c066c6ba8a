"""Category registry, product catalog, review coverage, niche population."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.functions.text import c
from sedgeline.session import cut, maybe_broadcast


@F.pandas_udf(T.StringType())
def display_label(x: pd.Series) -> pd.Series:
    """TX4: compatibility form, runs of white space to a blank, ends stripped; empty is null."""
    return x.map(lambda v: " ".join(unicodedata.normalize("NFKC", v).split()) or None if isinstance(v, str) else None)


@F.pandas_udf(T.StringType())
def matching_key(x: pd.Series) -> pd.Series:
    """TX5: the display form, case folded (which is more than lower case)."""
    return x.map(lambda v: " ".join(unicodedata.normalize("NFKC", v).split()).casefold() or None if isinstance(v, str) else None)


@F.pandas_udf(T.StringType())
def folded_path(x: pd.Series) -> pd.Series:
    """The matching key of a path: the keys of its labels, empty ones left out."""
    def key(labels) -> str | None:
        kept = [k for v in (labels if labels is not None else ()) if v is not None and (k := " ".join(unicodedata.normalize("NFKC", v).split()).casefold())]
        return " > ".join(kept) or None

    return x.map(key)


def with_path_key(catalog: DataFrame, column: str = "category_path") -> DataFrame:
    """TX5: rows with ``path_key``, null where no label is left.

    Keys are formed once for each distinct path, by Python for compatibility forms and case folding, and
    joined back (broadcast behind a check of their number).
    """
    keys = cut(catalog.select(column).where(F.size(column) > 0).distinct().withColumn("path_key", folded_path(column)))
    return catalog.join(maybe_broadcast(keys, 1000), column, "left")


def category_id(category, key, namespace: str = "amazon-category"):
    """TX6: namespace, colon and 24 hexadecimal digits of the category's and the key's sha256."""
    return F.concat(F.lit(f"{namespace}:"), F.substring(F.sha2(F.concat(c(category), F.lit("|"), key), 256), 1, 24))


def products(catalog: DataFrame) -> DataFrame:
    """Each product once: the row with the smallest record index, its id trimmed in upper case."""
    rows = catalog.withColumn("parent_asin", F.upper(F.trim("parent_asin"))).where(F.col("parent_asin") != "")
    w = Window.partitionBy("parent_asin").orderBy(F.col("source_record_index").asc_nulls_last(), F.col("product_title").asc_nulls_last())
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def registry(catalog: DataFrame, namespace: str = "amazon-category") -> DataFrame:
    """AG9: one row per category path (compared by its key) with its id, representative, depth, counts and product share."""
    rows = with_path_key(catalog).where("path_key is not null")
    out = rows.groupBy("dataset_category", "path_key").agg(F.min("category_path").alias("path"), F.count("*").alias("records"), F.count_distinct(F.upper(F.trim("parent_asin"))).alias("parents"), F.array_sort(F.collect_set(F.trim("main_category"))).alias("main"))
    total = rows.agg(F.count("*").alias("all"))
    columns = [category_id("dataset_category", F.col("path_key"), namespace).alias("category_path_id"), "path_key", F.array_join("path", " > ").alias("path_text"), F.size("path").cast("long").alias("depth"), F.try_element_at("path", F.lit(-1)).alias("leaf"), "records", "parents"]
    return out.crossJoin(F.broadcast(total)).select(*columns, F.size("main").cast("long").alias("main_categories"), (F.col("records").cast("double") / F.col("all")).alias("record_share"))


def category_nodes(catalog: DataFrame) -> DataFrame:
    """AG10: (depth, nodes): distinct prefixes of the paths."""
    paths = with_path_key(catalog.select("category_path").distinct()).where("path_key is not null").select(F.split("path_key", " > ").alias("k")).distinct()
    return paths.select(F.explode(F.sequence(F.lit(1), F.size("k"))).alias("depth"), "k").select(F.col("depth").cast("long").alias("depth"), F.slice("k", F.lit(1), F.col("depth")).alias("p")).distinct().groupBy("depth").agg(F.count("*").alias("nodes"))


def build(catalog: DataFrame, reviews: DataFrame, registered: DataFrame) -> DataFrame:
    """JN1-2, F5: every product once with its registered path (its own where none is registered), review coverage and quality flags.

    ``registered``: path_key, category_path_id, path_text (the display form). Reviews are
    counted by product before the join; a price that is not positive is invalid and taken as unknown.
    """
    own = with_path_key(products(catalog))
    known = registered.select("path_key", F.col("category_path_id").alias("known_id"), F.col("path_text").alias("known_text"))
    rows = own.join(maybe_broadcast(known, 400), "path_key", "left").join(coverage(reviews), "parent_asin", "left")
    price = F.col("price_at_collection")
    valid = price.isNotNull() & ~F.isnan(price) & (price > 0)
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    lacks = [(F.size("category_path") <= 0, "missing_category"), (blank("main_category"), "missing_main_category"), (price.isNull(), "missing_price"), (price.isNotNull() & ~valid, "invalid_price"), (F.col("rating_number").isNull(), "missing_rating_number"), (blank("store"), "missing_store"), (blank("product_title"), "missing_title"), (F.col("reviews").isNull(), "no_reviews")]
    return rows.select(
        "parent_asin", F.nullif(F.trim("product_title"), F.lit("")).alias("product_title"), F.nullif(F.trim("store"), F.lit("")).alias("store"),
        F.coalesce("known_id", F.nullif(F.trim("category_path_id"), F.lit(""))).alias("category_path_id"), F.coalesce("known_text", F.nullif(F.array_join("category_path", " > "), F.lit(""))).alias("category_path_text"), F.when(valid, price).alias("price"),
        F.coalesce("reviews", F.lit(0)).alias("review_count"), F.coalesce("asins", F.lit(0)).alias("reviewed_asin_count"), "first_ms", "last_ms", F.array_compact(F.array(*[F.when(cond, name) for cond, name in lacks])).alias("flags"),
    )


def build_summary(built: DataFrame) -> DataFrame:
    """AG8: one row of counts over the built catalog: products, reviewed ones, reviews, and products by flag."""
    flag = lambda x: F.count_if(F.array_contains("flags", x)).alias(x)
    names = ("missing_category", "missing_main_category", "missing_price", "invalid_price", "missing_rating_number", "missing_store", "missing_title", "no_reviews")
    return built.agg(F.count("*").alias("products"), F.count_if(F.col("review_count") > 0).alias("reviewed_products"), F.sum("review_count").alias("reviews"), F.count_distinct("category_path_id").alias("paths"), *[flag(x) for x in names])


def coverage(reviews: DataFrame) -> DataFrame:
    """AG7: by product the reviews, the distinct variations and the time span."""
    return reviews.groupBy("parent_asin").agg(F.count("*").alias("reviews"), F.count_distinct("asin").alias("asins"), F.unix_millis(F.min("ts")).alias("first_ms"), F.unix_millis(F.max("ts")).alias("last_ms"))


def join_coverage(reviews: DataFrame, catalog: DataFrame) -> DataFrame:
    """JN3, AG5: how many reviews have a product, and the reviews and products without the other.

    Counts by product come first, so that the join carries one row per product and no review.
    """
    own = reviews.groupBy("parent_asin").agg(F.count("*").alias("n"))
    both = own.join(products(catalog).select("parent_asin", F.lit(1).alias("known")), "parent_asin", "full_outer")
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("reviews"),
        F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).cast("long").alias("matched"),
        F.count_if(F.col("known") == 1).alias("products"),
        F.count_if((F.col("known") == 1) & F.col("n").isNotNull()).alias("reviewed_products"),
        F.count_if(F.col("known").isNull()).alias("unknown_products"),
    )


def quality_flags(catalog: DataFrame) -> DataFrame:
    """PRJ7, AG8: (flags, products): what each product lacks, as a sorted list in one text."""
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    flags = F.array_compact(F.array(F.when(blank("main_category"), "missing_main_category"), F.when(F.col("price_at_collection").isNull(), "missing_price"), F.when(F.col("rating_number").isNull(), "missing_rating_number"), F.when(blank("store"), "missing_store"), F.when(blank("product_title"), "missing_title")))
    return products(catalog).groupBy(F.array_join(flags, ",").alias("flags")).agg(F.count("*").alias("products"))


def search_text(catalog: DataFrame) -> DataFrame:
    """TX13: (parent_asin, search_text): title, store, category path and features in one text, white space collapsed."""
    parts = F.concat_ws(" ", "product_title", "store", F.array_join("category_path", " "), F.array_join("features", " "))
    return products(catalog).select("parent_asin", F.trim(F.regexp_replace(parts, r"[ \t\n\f\r]+", " ")).alias("search_text"))


def niche_population(reviews: DataFrame, catalog: DataFrame) -> DataFrame:
    """AG4-6, JN5: by leaf category the products, the reviewed ones, reviews, variations, verified and helpful votes.

    Reviews are aggregated by product before the join; distinct variations belong to one product each.
    """
    own = reviews.groupBy("parent_asin").agg(F.count("*").alias("reviews"), F.count_distinct("asin").alias("asins"), F.count_if("verified").alias("verified"), F.sum("helpful").alias("helpful"))
    both = products(catalog).select("parent_asin", F.trim("leaf_category").alias("leaf")).join(own, "parent_asin", "left")
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x)
    return both.groupBy("leaf").agg(F.count("*").alias("products"), F.count_if(F.col("reviews").isNotNull()).alias("reviewed_products"), zero("reviews"), zero("asins"), zero("verified"), zero("helpful"))


def niche_reviews(reviews: DataFrame, catalog: DataFrame, leaves: list[str]) -> DataFrame:
    """JN4, JN6, PRJ14: reviews of the products in the given leaf categories, with title, store and leaf (no user)."""
    own = products(catalog).where(F.trim("leaf_category").isin(leaves)).select("parent_asin", "product_title", "store", F.trim("leaf_category").alias("leaf"))
    return reviews.drop("user_id").join(own, "parent_asin")
