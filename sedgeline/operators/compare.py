"""One product against a group of others, product search, overviews, trends, competitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.functions.text import title_key
from sedgeline.operators.search import cosine_to, grams, tfidf_vectors
from sedgeline.session import cut, numbered

COUNTED = ("mentions", "needs_attention", "satisfied", "negative", "neutral", "positive")


def sides(mart: DataFrame, own: str, others: list[str]) -> DataFrame:
    """AG18: by aspect the sums of the own product and of the others, each prefixed, from one pass over the mart."""
    rows = mart.where(F.col("parent_asin").isin([own, *others]))
    is_own = F.col("parent_asin") == own
    sums = []
    for name, cond in (("own", is_own), ("other", ~is_own)):
        sums += [F.coalesce(F.sum(F.when(cond, F.col(k))), F.lit(0)).cast("long").alias(f"{name}_{k}") for k in COUNTED]
        sums.append(F.count_distinct(F.when(cond, F.col("parent_asin"))).alias(f"{name}_products"))
    return rows.groupBy("aspect_id").agg(*sums)


def comparison(mart: DataFrame, reviews: DataFrame, own: str, others: list[str], least: int = 20) -> DataFrame:
    """AG20, JN13: gaps in percentage points between the own product and the others by aspect.

    Discussion gap over reviews, attention and positive gap over mentions; the advantage is the
    positive gap less the attention gap; support needs ``least`` mentions on both sides.
    """
    is_own = F.col("parent_asin") == own
    totals = reviews.where(F.col("parent_asin").isin([own, *others])).agg(F.count_if(is_own).alias("own_reviews"), F.count_if(~is_own).alias("other_reviews"))
    df = sides(mart, own, others).crossJoin(F.broadcast(totals))
    pp = lambda k, total: 100 * (F.try_divide(F.col(f"own_{k}").cast("double"), F.col(f"own_{total}")) - F.try_divide(F.col(f"other_{k}").cast("double"), F.col(f"other_{total}")))
    df = df.withColumns({"discussion_gap_pp": pp("mentions", "reviews"), "attention_gap_pp": pp("needs_attention", "mentions"), "positive_gap_pp": pp("positive", "mentions")})
    return df.withColumn("advantage_pp", F.col("positive_gap_pp") - F.col("attention_gap_pp")).withColumn("support_sufficient", (F.col("own_mentions") >= least) & (F.col("other_mentions") >= least))


def weaknesses(compared: DataFrame, gap: float = 5.0, n: int = 10) -> DataFrame:
    """TK2: supported aspects whose attention gap reaches ``gap``, the widest first."""
    return compared.where(F.col("support_sufficient") & (F.col("attention_gap_pp") >= gap)).orderBy(F.col("attention_gap_pp").desc(), "aspect_id").limit(n)


def strengths(compared: DataFrame, gap: float = 5.0, least_share: float = 0.55, n: int = 10) -> DataFrame:
    """TK2: supported aspects, mostly positive, whose attention gap is -``gap`` or less."""
    share = F.try_divide(F.col("own_positive").cast("double"), F.col("own_mentions"))
    return compared.where(F.col("support_sufficient") & (share >= least_share) & (F.col("attention_gap_pp") <= -gap)).orderBy(F.col("advantage_pp").desc(), "aspect_id").limit(n)


def overview(reviews: DataFrame) -> DataFrame:
    """AG19: by product the reviews, rating sum, time span, months with reviews and helpful votes."""
    return reviews.groupBy("parent_asin").agg(F.count("*").alias("reviews"), F.sum("rating").cast("long").alias("rating_sum"), F.unix_millis(F.min("ts")).alias("first_ms"), F.unix_millis(F.max("ts")).alias("last_ms"), F.count_distinct(F.date_format("ts", "yyyy-MM")).alias("active_months"), F.sum("helpful").cast("long").alias("helpful"))


def aspect_trend(mentions: DataFrame, own: str) -> DataFrame:
    """AG36: the own product's mentions by aspect and month."""
    return mentions.where(F.col("parent_asin") == own).groupBy("aspect_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("mentions"), F.count_if(F.col("rating") <= 3).alias("needs_attention"), F.count_if(F.col("sentiment") == "positive").alias("positive"))


def product_search(catalog: DataFrame, text: str, n: int = 20, most_terms: int = 8) -> DataFrame:
    """TK1: products with the id asked for or with all terms; by exact id, title, number of reviews, id."""
    asked = " ".join(text.lower().split())
    terms = [t for t in asked.split(" ") if len(t) >= 2][:most_terms]
    body = F.lower(F.concat_ws(" ", "product_title", "store", "product_search_text"))
    exact = F.lower("parent_asin") == asked
    every = F.lit(bool(terms))
    for t in terms:
        every = every & body.contains(t)
    hit = catalog.where(exact | every)
    title = F.coalesce(F.lower("product_title").contains(asked), F.lit(False))
    return hit.orderBy(exact.desc(), title.desc(), F.col("review_count").desc_nulls_last(), "parent_asin").limit(n).select("parent_asin", "product_title", F.col("review_count").cast("long").alias("review_count"))


#: What speaks of buying again, and of not doing so, in text in lower case.
AGAIN = r"\b(?:would|will|definitely|certainly|probably)?\s*(?:buy|purchase|order|get)(?:\s+(?:it|this|these|the product))?\s+again\b|\b(?:repurchase|re-purchase|reorder|re-order)(?:d|ing)?\b|\bkeep(?:s|ing)?\s+(?:buying|purchasing|ordering)\b"
NEVER = r"\b(?:not|never|won't|wouldn't|will not|would not|don't|do not)\b.{0,35}\b(?:buy|purchase|order|get|repurchase|reorder)\b"


def repurchase(reviews: DataFrame, least: int = 3) -> DataFrame:
    """AG39, TX16: by product the reviews that speak of buying again and of not doing so, with a support flag."""
    t = F.lower(F.coalesce("text", F.lit("")))
    again, never = t.rlike(AGAIN) & ~t.rlike(NEVER), t.rlike(NEVER)
    distinct = lambda x: F.count_distinct(F.when(x, F.col("review_id")))
    out = reviews.groupBy("parent_asin").agg(F.count("*").alias("reviews"), distinct(again).alias("again"), distinct(never).alias("never"))
    return out.withColumn("again_share", F.try_divide(F.col("again").cast("double"), F.col("reviews"))).withColumn("supported", F.col("again") >= least)


def repurchase_ranking(signals: DataFrame, n: int = 10) -> DataFrame:
    """TK4: the ``n`` products with most reviews that speak of buying again, then the greater share, more reviews, the id."""
    return signals.orderBy(F.col("again").desc(), F.col("again_share").desc(), F.col("reviews").desc(), "parent_asin").limit(n)


def price_similarity(own: Column, other: Column) -> Column:
    """MA1: 1 at equal prices, 0 from a factor of four on, 0.5 where one is unknown; a price counts as a cent at least."""
    known = own.isNotNull() & other.isNotNull() & ~F.isnan(own) & ~F.isnan(other)
    a, b = (F.greatest(x.cast("double"), F.lit(0.01)) for x in (own, other))
    return F.when(known, F.greatest(F.lit(0.0), 1 - F.abs(F.log(b / a)) / F.log(F.lit(4.0)))).otherwise(0.5)


def same_brand(a: Column, b: Column) -> Column:
    """TX9: equal, or the shorter (of four characters or more) opens the longer before a blank."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) & (a != "") | ((F.length(short) >= 4) & long.startswith(F.concat(short, F.lit(" "))))


def concepts_of(title: Column, concepts: dict[str, list[str]]) -> Column:
    """AR3: the sorted names of the concepts of which a normal title (``title_key``) holds a phrase as whole words."""
    padded = F.concat(F.lit(" "), title, F.lit(" "))
    hit = lambda phrases: F.array_contains(F.transform(F.array(*[F.lit(f" {p} ") for p in phrases]), lambda p: padded.contains(p)), True)
    return F.array_compact(F.array(*[F.when(hit(v), F.lit(k)) for k, v in sorted(concepts.items())])) if concepts else F.array().cast("array<string>")


#: Weights of text, concepts, price and support.
WEIGHTS = (0.45, 0.30, 0.10, 0.15)


def competitors(catalog: DataFrame, own: str, concepts: dict[str, list[str]] | None = None, k: int = 4, least_reviews: int = 1) -> DataFrame:
    """ML12, MA2, WIN15: all rivals of the own category path with rank, ``selected`` and the parts of their score.

    Rivals are of another brand and have ``least_reviews``. The text part is the TF-IDF cosine of the titles of the own
    product and its rivals, the concept part the share of the own title's concepts. Ties go to more reviews, then the id. The ``k`` selected
    are the best of each brand (products without one stand for themselves), filled up by rank.
    """
    titled = catalog.select("parent_asin", "category_path_id", "store", "product_title", F.col("price_at_collection").alias("price"), F.coalesce("review_count", F.lit(0)).cast("long").alias("review_count"), title_key("product_title").alias("title"), title_key("store").alias("brand"))
    me = titled.where(F.col("parent_asin") == own).select(F.col("category_path_id").alias("cat"), F.col("brand").alias("brand0"), F.col("price").alias("price0"), concepts_of(F.col("title"), concepts or {}).alias("concepts0")).limit(1)
    pool = titled.join(F.broadcast(me), F.col("category_path_id") == F.col("cat"))
    is_own = F.col("parent_asin") == own
    pool = cut(pool.where(is_own | ((F.col("review_count") >= least_reviews) & ~same_brand(F.col("brand"), F.col("brand0")))))
    text = cosine_to(tfidf_vectors(grams(pool, "parent_asin", "title")), F.col("id") == own).select(F.col("id").alias("parent_asin"), F.col("score").alias("text_similarity"))
    rivals = pool.where(~is_own)
    most = rivals.agg(F.max(F.log1p("review_count")).alias("most"))
    scored = rivals.crossJoin(F.broadcast(most)).join(text, "parent_asin", "left").withColumn("matched_concepts", F.array_intersect(concepts_of(F.col("title"), concepts or {}), "concepts0"))
    parts = [F.coalesce("text_similarity", F.lit(0.0)), F.size("matched_concepts").cast("double") / F.greatest(F.lit(1), F.size("concepts0")), price_similarity(F.col("price0"), F.col("price")), F.coalesce(F.try_divide(F.log1p("review_count"), F.col("most")), F.lit(0.0))]
    names = ("text_similarity", "concept_similarity", "price_similarity", "support")
    scored = scored.withColumns(dict(zip(names, parts))).withColumn("score", sum((w * F.col(n) for w, n in zip(WEIGHTS[1:], names[1:])), WEIGHTS[0] * F.col(names[0])))
    ranked = numbered(scored, [F.col("score").desc(), F.col("review_count").desc(), F.col("parent_asin")], "rank")
    best = ranked.groupBy(F.when(F.col("brand") == "", F.concat(F.lit("="), F.col("parent_asin"))).otherwise(F.col("brand")).alias("b")).agg(F.min("rank").alias("rank"), F.lit(True).alias("first"))
    ranked = ranked.join(best.select("rank", "first"), "rank", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    chosen = ranked.orderBy(F.col("first").desc(), "rank").limit(k).select("rank", F.lit(True).alias("selected"))
    return ranked.join(F.broadcast(chosen), "rank", "left").withColumn("selected", F.coalesce("selected", F.lit(False))).select("rank", "selected", "parent_asin", "store", "product_title", "price", "review_count", "score", *names, "matched_concepts")
