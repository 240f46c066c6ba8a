"""Leakage-safe sentiment splits and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.functions.text import bucket100, fingerprint
from sedgeline.operators.sampling import order_key
from sedgeline.session import cut

#: Bucket borders: train below the first, validation below the second, test from there.
TRAIN_BELOW, VALIDATION_BELOW = 80, 90


def labelled(reviews: DataFrame, catalog: DataFrame, leaf: str) -> DataFrame:
    """Reviews with label, text fingerprint, product bucket and whether the product is in the niche.

    Hash keys are formed once here; both later passes read the same columns.
    """
    niche = catalog.select("parent_asin", (F.trim("leaf_category") == leaf).alias("is_niche"))
    label = F.when(F.col("rating") <= 2, "negative").when(F.col("rating") == 3, "neutral").otherwise("positive")
    return reviews.join(niche, "parent_asin", "left").select("review_id", "parent_asin", "user_id", "rating", "ts", F.coalesce("is_niche", F.lit(False)).alias("is_niche"), label.alias("sentiment_label"), fingerprint("text").alias("print"), bucket100("parent_asin").alias("bucket"))


def candidates(rows: DataFrame, cutoff: str) -> DataFrame:
    """Each review's candidate split.

    Niche products form a test of their own; before the cutoff the product's bucket decides; after it
    rows of products that were seen in training before the cutoff form the temporal test. Others drop out.
    """
    early = F.col("ts") < F.lit(cutoff).cast("timestamp")
    seen = rows.where(early & ~F.col("is_niche") & (F.col("bucket") < TRAIN_BELOW)).select("parent_asin").distinct().withColumn("seen", F.lit(True))
    split = (
        F.when(F.col("is_niche"), "test_niche")
        .when(early & (F.col("bucket") < TRAIN_BELOW), "train")
        .when(early & (F.col("bucket") < VALIDATION_BELOW), "validation")
        .when(early, "test_product")
        .when(F.col("seen"), "test_temporal")
    )
    return rows.join(seen, "parent_asin", "left").withColumn("split_name", split).drop("seen").where("split_name is not null")


def one_text_per_split(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Texts that stand in more than one split leave all of them; of the others one row stays, the first by hash."""
    across = rows.groupBy("print").agg(F.min("split_name").alias("lo"), F.max("split_name").alias("hi")).where("lo = hi").select("print")
    w = Window.partitionBy("split_name", "print").orderBy(order_key("review_id", seed), "review_id")
    return rows.join(across, "print", "left_semi").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def sentiment_sample(reviews: DataFrame, catalog: DataFrame, leaf: str, cutoff: str, per_class: dict[str, int], temporal: int, seed: int = 42) -> DataFrame:
    """SMP10: the split manifest.

    ``per_class``: rows by class for each split (a split with quota 0 takes none). Temporal rows are
    drawn without regard to class, only of products that the selected training rows hold. Constant limits let
    Spark cut each task's part of a window before the shuffle.
    """
    # both are read several times: cut, so that hashes and windows are formed once
    unique = cut(one_text_per_split(cut(candidates(labelled(reviews, catalog, leaf), cutoff)), seed))
    by_class = Window.partitionBy("split_name", "sentiment_label").orderBy(F.md5(F.concat_ws(":", "review_id", "sentiment_label", F.lit(str(seed)))), "review_id")
    quota = F.create_map(*[F.lit(x) for kv in per_class.items() for x in kv])
    classed = unique.where(F.col("split_name").isin(list(per_class))).withColumn("rn", F.row_number().over(by_class)).where((F.col("rn") <= max(per_class.values())) & (F.col("rn") <= quota[F.col("split_name")])).drop("rn")
    products = classed.where("split_name = 'train'").select("parent_asin").distinct()
    late = unique.where("split_name = 'test_temporal'").join(products, "parent_asin", "left_semi")
    order = F.md5(F.concat_ws(":", "review_id", F.lit("temporal"), F.lit(str(seed))))
    late = late.orderBy(order, "review_id").limit(temporal)
    return classed.unionByName(late.select(*classed.columns))


def audit(manifest: DataFrame) -> DataFrame:
    """AG37: by split the rows, distinct products and users, and how many of them the training split has too."""
    train = manifest.where("split_name = 'train'")
    p = train.select("parent_asin").distinct().withColumn("tp", F.lit(True))
    u = train.select("user_id").where("user_id is not null").distinct().withColumn("tu", F.lit(True))
    both = manifest.join(p, "parent_asin", "left").join(u, "user_id", "left")
    return both.groupBy("split_name").agg(F.count("*").alias("records"), F.count_distinct("parent_asin").alias("products"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("tp"), F.col("parent_asin"))).alias("train_products"), F.count_distinct(F.when(F.col("tu"), F.col("user_id"))).alias("train_users"))
