"""Aspect extraction by aliases, mention statistics, marts, rankings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Evidence spans of one aspect in one review.
MOST_SPANS = 5


def alias_owner(aliases: dict[str, list[str]]) -> dict[str, str]:
    """Alias (lower case, single blanks) -> aspect; an alias with two owners is an error."""
    owner: dict[str, str] = {}
    for aspect, names in aliases.items():
        for n in names:
            key = " ".join(n.lower().split())
            if owner.setdefault(key, aspect) != aspect:
                raise ValueError(f"alias {key!r} belongs to {owner[key]} and {aspect}")
    return owner


def alias_pattern(aliases: dict[str, list[str]]) -> str:
    """TX15: one alternation over all aspects, longest alias first, so that matches never overlap."""
    names = sorted(alias_owner(aliases), key=lambda n: (-len(n), n))
    return "(?<![a-z0-9_])(?:" + "|".join(re.escape(n).replace(r"\ ", r"\s+") for n in names) + ")(?![a-z0-9_])"


def alias_mentions(reviews: DataFrame, aliases: dict[str, list[str]], text: str = "text") -> DataFrame:
    """ML1 without offsets, in the JVM: (review_id, aspect_id, evidence_count), at most MOST_SPANS counted."""
    owner = alias_owner(aliases)
    lookup = F.create_map(*[F.lit(x) for kv in sorted(owner.items()) for x in kv])
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(alias_pattern(aliases)), F.lit(0))
    rows = reviews.select("review_id", F.explode(found).alias("m"))
    named = rows.select("review_id", lookup[F.regexp_replace("m", r"\s+", " ")].alias("aspect_id"))
    return named.groupBy("review_id", "aspect_id").agg(F.least(F.count("*"), F.lit(MOST_SPANS)).alias("evidence_count"))


SPAN = "array<struct<text:string,start:int,end:int,alias:string>>"


def alias_evidence(reviews: DataFrame, aliases: dict[str, list[str]], text: str = "text") -> DataFrame:
    """ML1 with offsets: (review_id, aspect_id, evidence); the text between start and end is the evidence itself."""
    owner, pattern = alias_owner(aliases), re.compile(alias_pattern(aliases), re.IGNORECASE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rid, t in zip(pdf["review_id"], pdf[text]):
                own: dict[str, list] = {}
                for m in pattern.finditer(t or ""):
                    alias = " ".join(m.group().lower().split())
                    spans = own.setdefault(owner[alias], [])
                    if len(spans) < MOST_SPANS:
                        spans.append({"text": m.group(), "start": m.start(), "end": m.end(), "alias": alias})
                out += [(rid, a, s) for a, s in sorted(own.items())]
            yield pd.DataFrame(out, columns=["review_id", "aspect_id", "evidence"])

    return reviews.select("review_id", text).mapInPandas(run, f"review_id string, aspect_id string, evidence {SPAN}")


def extraction_coverage(reviews: DataFrame, mentions: DataFrame) -> DataFrame:
    """AG26: reviews, those with a mention, mentions, spans."""
    m = mentions.agg(F.count_distinct("review_id").alias("matched"), F.count("*").alias("mentions"), F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("spans"))
    return reviews.agg(F.count("*").alias("reviews")).crossJoin(m).withColumn("unmatched", F.col("reviews") - F.col("matched"))


def latest(mentions: DataFrame) -> DataFrame:
    """One row per review and aspect (ids compared case and blanks aside), the latest scored; unusable ids drop out."""
    m = mentions.select("review_id", F.upper(F.trim("parent_asin")).alias("parent_asin"), F.lower(F.trim("aspect_id")).alias("aspect_id"), F.col("rating").cast("int").alias("rating"), F.col("review_timestamp").alias("ts"), F.coalesce("helpful_vote", F.lit(0)).alias("helpful"), F.col("aspect_probability").cast("double").alias("probability"), F.lower(F.trim("aspect_sentiment")).alias("sentiment"), F.col("aspect_sentiment_score").alias("score"), F.col("prediction_sources_json").alias("sources"), F.col("evidence_json").alias("evidence"), "scored_at")
    keys = ["review_id", "aspect_id"]
    rest = ["scored_at", *[c for c in m.columns if c not in (*keys, "scored_at")]]
    return m.where("review_id is not null and aspect_id <> ''").groupBy(*keys).agg(F.max(F.struct(*rest)).alias("x")).select(*keys, "x.*")


def counters() -> list:
    """Sums every mart has; counts are exact integers."""
    one = lambda cond, name: F.count_if(cond).alias(name)
    s = F.col("sentiment")
    return [
        F.count("*").alias("mentions"),
        F.sum("rating").cast("long").alias("rating_sum"),
        one(F.col("rating") <= 3, "needs_attention"),
        one(F.col("rating") >= 4, "satisfied"),
        one(s == "negative", "negative"),
        one(s == "neutral", "neutral"),
        one(s == "positive", "positive"),
        one(F.array_contains(F.from_json("sources", "array<string>"), "alias"), "alias_evidence"),
    ]


def shares(df: DataFrame, total: str = "mentions") -> DataFrame:
    """The counters as shares; null where there is nothing to share (MA4)."""
    return df.withColumns({f"{k}_share": F.try_divide(F.col(k).cast("double"), F.col(total)) for k in ("needs_attention", "satisfied", "negative", "positive")})


def statistics(mentions: DataFrame, approved: list[str] | None = None) -> DataFrame:
    """AG13: by aspect the counters, distinct reviews and products, shares. An approved aspect without rows is an error."""
    out = shares(mentions.groupBy("aspect_id").agg(*counters(), F.count_distinct("review_id").alias("reviews"), F.count_distinct("parent_asin").alias("products")))
    if approved is not None:
        missing = set(approved) - {r["aspect_id"] for r in out.select("aspect_id").collect()}
        if missing:
            raise ValueError(f"no mentions of {sorted(missing)}")
    return out


def top_examples(mentions: DataFrame, n: int = 3) -> DataFrame:
    """WIN10: (aspect_id, sentiment, place, review_id): the n best examples by score, votes, review."""
    w = Window.partitionBy("aspect_id", "sentiment").orderBy(F.col("score").desc(), F.col("helpful").desc(), "review_id")
    ok = mentions.where("score is not null and not isnan(score)")
    return ok.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n).select("aspect_id", "sentiment", "place", "review_id")


def product_mart(mentions: DataFrame, reviews: DataFrame, catalog: DataFrame) -> DataFrame:
    """AG14-15, WIN6: by product and aspect the counters, shares of the product's reviews, ranks within the product."""
    totals = reviews.groupBy("parent_asin").agg(F.count("*").alias("product_reviews"), F.sum("rating").cast("long").alias("product_rating_sum"))
    mart = mentions.groupBy("parent_asin", "aspect_id").agg(*counters(), F.unix_millis(F.min("ts")).alias("first_ms"), F.unix_millis(F.max("ts")).alias("last_ms"))
    mart = shares(mart.join(totals, "parent_asin", "left").join(catalog.select("parent_asin", F.trim("leaf_category").alias("niche")), "parent_asin", "left"))
    mart = mart.withColumn("review_share", F.try_divide(F.col("mentions").cast("double"), F.col("product_reviews")))
    rank = lambda k: F.dense_rank().over(Window.partitionBy("parent_asin").orderBy(F.col(k).desc())).cast("long")
    return mart.withColumns({"frequency_rank": rank("mentions"), "complaint_rank": rank("negative"), "strength_rank": rank("positive")})


def top_evidence(mentions: DataFrame) -> DataFrame:
    """WIN11: by product, aspect and sentiment the review with the best score, then votes, then id, by one aggregate."""
    ok = mentions.where("score is not null and not isnan(score) and sentiment in ('negative', 'positive')")
    w = Window.partitionBy("parent_asin", "aspect_id", "sentiment").orderBy(F.col("score").desc(), F.col("helpful").desc(), "review_id")
    return ok.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("parent_asin", "aspect_id", "sentiment", "review_id", "evidence")


def month_mart(mentions: DataFrame, reviews: DataFrame) -> DataFrame:
    """AG17, JN16, WIN8: every month with every aspect, zero-filled, shares null at zero, change against the month before.

    The grid is the product of two short lists (months, aspects), not of rows.
    """
    month = F.date_format("ts", "yyyy-MM").alias("month")
    counted = mentions.groupBy(month, "aspect_id").agg(*counters(), F.count_distinct("parent_asin").alias("products"))
    population = reviews.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("month_reviews"), F.count_distinct("parent_asin").alias("month_products"))
    aspects = mentions.select("aspect_id").distinct()
    grid = population.crossJoin(aspects)
    zero = [c for c in counted.columns if c not in ("month", "aspect_id", "rating_sum")]
    mart = shares(grid.join(counted, ["month", "aspect_id"], "left").na.fill(0, zero))
    mart = mart.withColumn("review_share", F.try_divide(F.col("mentions").cast("double"), F.col("month_reviews")))
    w = Window.partitionBy("aspect_id").orderBy("month")
    return mart.withColumn("previous_mentions", F.lag("mentions").over(w)).withColumn("mentions_change", F.col("mentions") - F.col("previous_mentions")).withColumn("share_change", F.col("review_share") - F.lag("review_share").over(w))


def rankings(mart: DataFrame, least_reviews: int = 10, least_mentions: int = 3, least_sentiment: int = 2, strength: int = 10) -> DataFrame:
    """AG21, WIN7: products ranked within niche and aspect by smoothed positive and negative shares (``_rank``) and counts (``_frequency_rank``), and each product's aspects by counts (``_reason_rank``).

    The prior is the share over all rows of the niche and aspect that pass the policy; ranks count
    only rows with enough mentions of the sentiment, others have none.
    """
    ok = mart.where((F.col("product_reviews") >= least_reviews) & (F.col("mentions") >= least_mentions) & F.col("niche").isNotNull())
    group = Window.partitionBy("niche", "aspect_id")
    out = ok
    for k in ("positive", "negative"):
        prior = F.sum(k).over(group).cast("double") / F.sum("mentions").over(group)
        out = out.withColumn(f"{k}_smoothed", (F.col(k) + F.lit(float(strength)) * prior) / (F.col("mentions") + strength))
        enough = F.col(k) >= least_sentiment
        place = lambda by, value: F.when(enough, F.rank().over(Window.partitionBy(*by, enough).orderBy(F.col(value).desc())).cast("long"))  # noqa: B023, E731
        niche = ("niche", "aspect_id")
        out = out.withColumns({f"{k}_rank": place(niche, f"{k}_smoothed"), f"{k}_frequency_rank": place(niche, k), f"{k}_reason_rank": place(("parent_asin",), k)})
    average = F.try_divide(F.col("product_rating_sum").cast("double"), F.col("product_reviews"))
    return out.withColumn("recurring_complaint", (average >= 4.0) & (F.col("negative") >= 3))


def recurring_complaints(ranked: DataFrame) -> DataFrame:
    """WIN17: of products with a recurring complaint their most frequent one."""
    w = Window.partitionBy("parent_asin").orderBy(F.col("negative").desc(), "aspect_id")
    return ranked.where("recurring_complaint").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("parent_asin", "niche", "aspect_id", "negative", "mentions")


def leaders(ranked: DataFrame, n: int = 3, rank: str = "positive_rank") -> DataFrame:
    """TK3, TK5: by niche and aspect the n first products of a ranking, positive or negative."""
    w = Window.partitionBy("niche", "aspect_id").orderBy(F.col(rank).asc_nulls_last(), F.col("mentions").desc(), "parent_asin")
    return ranked.where(F.col(rank).isNotNull()).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n).select("niche", "aspect_id", "place", "parent_asin", rank)


def reliability(scores: DataFrame, support: str = "support", f1: str = "f1") -> DataFrame:
    """ML14: strong from 20 and 0.70, usable from 10 and 0.55, directional from 5 and 0.35, else experimental."""
    n, f = F.col(support), F.col(f1)
    tier = F.when((n >= 20) & (f >= 0.70), "strong").when((n >= 10) & (f >= 0.55), "usable").when((n >= 5) & (f >= 0.35), "directional").otherwise("experimental")
    return scores.withColumn("reliability_tier", tier)
