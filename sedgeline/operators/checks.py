"""Record adapters, structural checks, manual-review summaries, text size profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.functions.text import c


def optional_number(x: Column | str, low: float, high: float) -> Column:
    """PRJ6, TC1: a number within the bounds, else null (also for text that is none, NaN and infinities)."""
    n = c(x).try_cast("double")
    return F.when(~F.isnan(n) & n.between(low, high), n)


def text_list(x: Column | str) -> Column:
    """PRJ6, AR1: the non-blank texts of an array, trimmed; null counts as an empty one."""
    return F.filter(F.transform(F.coalesce(c(x), F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))


def product_record(raw: DataFrame) -> DataFrame:
    """PRJ6: raw product metadata (all text but the arrays) to typed columns with quality flags, in fixed order."""
    price, rating, number = optional_number("price", 0, 1e9), optional_number("average_rating", 0, 5), optional_number("rating_number", 0, 2**53)
    flags = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "missing_title"),
            F.when(F.col("price").isNull(), "missing_price").when(price.isNull(), "invalid_price"),
            F.when(F.col("average_rating").isNotNull() & rating.isNull(), "invalid_average_rating"),
            F.when(F.col("rating_number").isNotNull() & (number.isNull() | (number != F.floor(number))), "invalid_rating_number"),
            F.when(F.size(text_list("categories")) == 0, "missing_category"),
        )
    )
    return raw.select(F.trim("parent_asin").alias("parent_asin"), F.nullif(F.trim("title"), F.lit("")).alias("product_title"), F.nullif(F.trim("store"), F.lit("")).alias("store"), rating.alias("average_rating"), F.when(number == F.floor(number), number.cast("long")).alias("rating_number"), price.alias("price_at_collection"), text_list("categories").alias("category_path"), text_list("features").alias("features"), flags.alias("metadata_quality_flags"))


def duplicates(df: DataFrame, keys: list[str], most: int = 1) -> DataFrame:
    """AG11: keys that repeat, with their number; ``most`` examples."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc(), *keys).limit(most)


def depends(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """AG16: keys that carry more than one value (null is a value) of a column that should depend on them."""
    counts = df.groupBy(key).agg(*[F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col(v).cast("string")), F.lit("null"))).alias(v) for v in values])
    return counts.where(F.greatest(*[F.col(v) for v in values], F.lit(0)) > 1)


def one_version(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """PRJ18: the single version of each column; rows of several versions, or none, are an error."""
    r = df.agg(*[F.min(x).alias(f"lo_{x}") for x in columns], *[F.max(x).alias(f"hi_{x}") for x in columns], *[F.count_if(F.col(x).isNull()).alias(f"no_{x}") for x in columns]).first()
    for x in columns:
        if r[f"lo_{x}"] != r[f"hi_{x}"] or r[f"no_{x}"] or r[f"lo_{x}"] is None:
            raise ValueError(f"{x}: {r[f'lo_{x}']} and {r[f'hi_{x}']} are mixed, {r[f'no_{x}']} rows have none")
    return {x: r[f"lo_{x}"] for x in columns}


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """AG25: (value, n, share) with null as a value."""
    from sedgeline.operators.profile import distribution

    return distribution(df, F.col(column), column)


def size_profile(df: DataFrame, batch: str, text: str) -> DataFrame:
    """AG43: rows and characters of every request batch."""
    n = F.length(text)
    return df.groupBy(batch).agg(F.count("*").alias("rows"), F.sum(n).alias("characters"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"))


def review_queue(rows: DataFrame, group: Column, key: str, n: int, seed: int = 42) -> DataFrame:
    """SMP13: at most ``n`` rows of every group for manual review, in hash order."""
    from sedgeline.operators.sampling import per_stratum

    return per_stratum(rows.withColumn("review_group", group), ["review_group"], key, n, seed).drop("rn")


def manual_summary(rows: DataFrame, label: str = "sentiment_label", predicted: str = "predicted_label", manual: str = "manual_label", group: str = "review_group") -> DataFrame:
    """AG35: by group how often a person agrees with the label and with the prediction; unreviewed rows are counted apart."""
    done = F.nullif(F.trim(manual), F.lit("")).isNotNull()
    agree = lambda x: F.count_if(done & (F.col(manual) == F.col(x)))
    out = rows.groupBy(group).agg(F.count("*").alias("rows"), F.count_if(done).alias("reviewed"), agree(label).alias("agrees_with_label"), agree(predicted).alias("agrees_with_prediction"))
    return out.withColumns({f"{k}_rate": F.try_divide(F.col(k).cast("double"), F.col("reviewed")) for k in ("agrees_with_label", "agrees_with_prediction")})


def set_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """SET3: (only_first, only_second, both): distinct keys of two frames, from which subset, disjointness and equality follow."""
    x, y = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    both = x.join(y, key, "full_outer")
    return both.agg(F.count_if(F.col("__b").isNull()).alias("only_first"), F.count_if(F.col("__a").isNull()).alias("only_second"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("both"))
