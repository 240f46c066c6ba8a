"""P7. The same or almost the same record in an evaluation split and in training: weighted cosine join.

A text is a vector over the elements of its bag (word and occurrence), each
of weight 1, scaled to length 1. Intersection over union of t means
|A and B| >= t/(1+t) * (|A|+|B|), so the cosine |A and B| / sqrt(|A||B|) is at least
2t/(1+t): a cosine join with that threshold loses no pair.

Elements are ordered from rare to frequent, by counts over all texts. A
training vector stands in inverted lists with its first elements only, and an
evaluation vector looks up its first elements only. What is left out must add so
little, by the smaller of two bounds, that a pair with less than LEAST common first elements
cannot reach the threshold: the norm of the rest (residual norm), and the number of left-out elements times
their weight times the maximum weight of the vectors of the other block. Of the pairs
that meet, those whose popcounts by segment lie too far apart are dropped (the bound of
the near-duplicates); the others get their exact dot product. Equal bags are
one text, so a group of copies costs one list entry.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.functions.text import id_upper, split_key, strip
from sedgeline.llm.bags import LEAST, Block, bag_rows, bags_of, length_pairs, meet, near_pairs, packed, place_counts, verified
from sedgeline.llm.neardup import review_texts
from sedgeline.session import cut


def first_part(n: np.ndarray, other: float, similarity: float, least: int) -> np.ndarray:
    """How many of its rarest elements a vector of n elements must show to vectors of at least ``other`` elements.

    With ``least`` - 1 common elements before it, the left-out rest of k elements
    keeps the cosine under the threshold if its residual norm sqrt(k/n) or its sum of
    maximum weights k / sqrt(n * other) is small enough.
    """
    other = np.maximum(other, n * similarity)
    left = 2 * similarity / (1 + similarity) - 1e-9 - (least - 1) / np.sqrt(n * other)
    by_norm, by_weight = n * np.maximum(left, 0) ** 2, np.sqrt(n * other) * left
    rest = np.ceil(np.maximum(by_norm, by_weight)) - 1
    return (n - np.clip(rest, 0, n)).astype(np.int64)


def search(x: pd.Series, y: pd.Series, similarity: float) -> pd.DataFrame:
    """Pairs of block a (asked) and block b (indexed) that the bounds let through."""
    a, b = Block.of(x), Block.of(y)
    lo_a, lo_b = int(a.n.min()), int(b.n.min())
    least = max(1, min(LEAST, math.ceil(similarity * max(lo_a, lo_b) - 1e-9)))
    return near_pairs(a, b, False, first_part(a.n, lo_b, similarity, least), first_part(b.n, lo_a, similarity, least), least, similarity)


def cosine_links(asked: DataFrame, indexed: DataFrame, both: DataFrame, similarity: float) -> DataFrame:
    """(x, y, shared, nx, ny): all pairs of an asked and an indexed bag of ``both`` (bag, n, bow) that are alike, exactly."""
    count = place_counts(both)
    one, two = (packed(side, count, lambda n: first_part(n, 0.0, similarity, LEAST)) for side in (asked, indexed))
    found = meet(one, two, length_pairs(one, two, similarity), lambda a, b: search(a, b, similarity), "x binary, y binary")
    return verified(cut(found), both, similarity)


def manifest_rows(sentiment: DataFrame) -> DataFrame:
    """(review_id, split, parent_asin, print): rows of the manifest with a split and an id, repeats once."""
    return sentiment.select(F.nullif(strip("review_id"), F.lit("")).alias("review_id"), split_key("split_name").alias("split"), id_upper("parent_asin").alias("parent_asin"), print_key().alias("print")).where("review_id is not null and split is not null").distinct()


def print_key():
    return F.nullif(F.lower(strip("text_fingerprint")), F.lit(""))


def overlaps(sentiment: DataFrame, reviews: DataFrame, similarity: float = 0.7, least_words: int = 20) -> DataFrame:
    """(review_id, split, parent_asin, by_print, by_text): evaluation reviews that also stand in ``train``.

    ``by_print``: a training review has the same fingerprint (letter case and
    blanks aside; null and empty ones match nothing). ``by_text``: a training review's text is alike,
    of texts with at least ``least_words`` words. The split is that of the manifest; a text
    whose review has no split there takes no part. With repeated or several texts
    of one review any of them counts.
    """
    rows = cut(manifest_rows(sentiment))
    train, other = rows.where("split = 'train'"), rows.where("split <> 'train'")
    prints = other.join(train.select("print").where("print is not null").distinct(), "print", "left_semi").select("review_id").distinct()
    texts = review_texts(reviews)
    sides = rows.groupBy("review_id").agg(F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_other"))
    own = cut(bag_rows(texts, least_words).withColumnRenamed("id", "review_id"))
    members = own.select("review_id", "bag").distinct().join(sides, "review_id")
    flags = members.groupBy("bag").agg(F.max("in_train").alias("in_train"), F.max("in_other").alias("in_other"))
    bags = cut(bags_of(own).join(flags, "bag"))
    hit = cosine_links(bags.where("in_other"), bags.where("in_train"), bags, similarity).select(F.col("x").alias("bag"))
    hit = hit.unionByName(bags.where("in_other and in_train").select("bag")).distinct()
    by_text = members.where("in_other").join(hit, "bag", "left_semi").select("review_id").distinct()
    out = other.select("review_id", "split", "parent_asin").distinct()
    out = out.join(prints.withColumn("by_print", F.lit(True)), "review_id", "left").join(by_text.withColumn("by_text", F.lit(True)), "review_id", "left")
    return out.na.fill(False, ["by_print", "by_text"]).where("by_print or by_text")


def overlap_counts(sentiment: DataFrame, reviews: DataFrame, similarity: float = 0.7, least_words: int = 20) -> DataFrame:
    """(split_name, parent_asin, reviews, by_print, by_text): overlapping reviews by split and product."""
    o = overlaps(sentiment, reviews, similarity, least_words)
    one = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return o.groupBy(F.col("split").alias("split_name"), "parent_asin").agg(F.count_distinct("review_id").alias("reviews"), one("by_print"), one("by_text"))
