"""From labelled observations to candidates and a taxonomy; request batches; saturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.operators.sampling import order_key
from sedgeline.session import numbered


def candidate_key(x: Column) -> Column:
    """TX14 for text that is already in compatible form: lower case, anything but a-z and 0-9 to a blank."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), F.lit(""))


def candidates(observations: DataFrame, eligible_reviews: int = 2, eligible_products: int = 2) -> DataFrame:
    """AG22, LM3, WIN16: by candidate its most frequent label, support and rank.

    Observations (review_id, parent_asin, label, topic_type, weight) are taken once per review and
    candidate, so a review that names a candidate twice counts and weighs once.
    """
    keyed = observations.withColumn("candidate_key", candidate_key(F.col("label"))).where("candidate_key is not null")
    labels = keyed.groupBy("candidate_key", "label").agg(F.count("*").alias("n"))
    name = labels.groupBy("candidate_key").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("canonical_label"), F.array_sort(F.collect_set("label")).alias("labels"))
    topics = keyed.groupBy("candidate_key", "topic_type").agg(F.count("*").alias("n")).groupBy("candidate_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("topic_type", F.lit("unknown")).alias("k"), "n")))).alias("topic_types"))
    once = keyed.groupBy("candidate_key", "review_id").agg(F.max("weight").alias("weight"), F.min("parent_asin").alias("parent_asin"), F.count("*").alias("mentions"))
    support = once.groupBy("candidate_key").agg(F.sum("mentions").alias("mentions"), F.count("*").alias("reviews"), F.count_distinct("parent_asin").alias("products"), F.sum("weight").alias("weighted_support"))
    out = support.join(name, "candidate_key").join(topics, "candidate_key")
    ranked = numbered(out, [F.col("weighted_support").desc(), F.col("reviews").desc(), F.col("candidate_key")], "support_rank")
    return ranked.withColumn("eligible", (F.col("reviews") >= eligible_reviews) & (F.col("products") >= eligible_products))


def uncovered(candidates_: DataFrame, owners: DataFrame) -> DataFrame:
    """LM4: candidates that a normalisation maps to nothing."""
    return candidates_.join(owners.select("candidate_key").distinct(), "candidate_key", "left_anti")


def proposal(observations: DataFrame, owners: DataFrame, evidence: int = 5) -> DataFrame:
    """AG23: by aspect its support over the mapped candidates and the reviews with the greatest weights.

    ``owners``: (candidate_key, aspect_id), each key once.
    """
    own = observations.withColumn("candidate_key", candidate_key(F.col("label"))).join(owners, "candidate_key")
    once = own.groupBy("aspect_id", "review_id").agg(F.max("weight").alias("weight"), F.min("parent_asin").alias("parent_asin"))
    support = once.groupBy("aspect_id").agg(F.count("*").alias("reviews"), F.count_distinct("parent_asin").alias("products"), F.sum("weight").alias("weighted_support"))
    w = Window.partitionBy("aspect_id").orderBy(F.col("weight").desc(), "review_id")
    top = once.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= evidence).groupBy("aspect_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "review_id"))), lambda x: x["review_id"]).alias("evidence_ids"))
    return support.join(top, "aspect_id")


def batches(sample: DataFrame, stratum: str, size: int, seed: int = 42) -> DataFrame:
    """LM1, WIN12: reviews in request batches that go round the strata: first of each, second of each, and so on.

    The place in the stratum and the number in the whole order are found in parallel.
    """
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(order_key("review_id", seed), "review_id"))
    rows = numbered(sample.withColumn("round", place), [F.col("round"), F.col(stratum), F.col("review_id")], "__number")
    return rows.withColumn("batch", F.floor((F.col("__number") - 1) / size).cast("long")).drop("round", "__number")


def saturation(observations: DataFrame, batch: str, every: int = 5, low: int = 5) -> DataFrame:
    """AG38: by checkpoint of ``every`` batches, from the first batch there is, the candidates seen so far, the new ones and whether growth is low."""
    first = observations.withColumn("candidate_key", candidate_key(F.col("label"))).where("candidate_key is not null").groupBy("candidate_key").agg(F.min(batch).alias("first"))
    point = (F.floor(F.col("first") / every) + 1).cast("long")
    new = first.groupBy(point.alias("checkpoint")).agg(F.count("*").alias("new_candidates"))
    ends = observations.agg(*[(F.floor(f(batch) / every) + 1).cast("long").alias(n) for f, n in ((F.min, "first"), (F.max, "last"))])
    points = ends.where("last is not null").select(F.explode(F.sequence("first", "last")).alias("checkpoint"))
    run = Window.partitionBy().orderBy("checkpoint").rowsBetween(Window.unboundedPreceding, 0)
    out = points.join(new, "checkpoint", "left").na.fill(0, ["new_candidates"])
    return out.withColumn("candidates", F.sum("new_candidates").over(run)).withColumn("low_growth", F.col("new_candidates") <= low)


def training_labels(mentions: DataFrame, reviewed: DataFrame) -> DataFrame:
    """ML15: (review_id, aspects): the sorted aspects of every review by a reviewed mapping (candidate_key, aspect_id)."""
    return mentions.withColumn("candidate_key", candidate_key(F.col("label"))).join(reviewed, "candidate_key").groupBy("review_id").agg(F.array_sort(F.collect_set("aspect_id")).alias("aspects"))


def combine_waves(waves: dict[str, DataFrame], weights: DataFrame) -> DataFrame:
    """LM6: samples of several waves with their final weights; a review in two waves or without weight is an error."""
    out = None
    for name, df in sorted(waves.items()):
        own = df.withColumn("wave", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    twice = out.groupBy("review_id").count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError("a review stands in two waves")
    if out.join(weights, "review_id", "left_anti").limit(1).count():
        raise ValueError("a review has no final weight")
    return out.drop("sampling_weight").join(weights.select("review_id", F.col("weight").alias("sampling_weight")), "review_id")
