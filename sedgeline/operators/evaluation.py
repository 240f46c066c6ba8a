"""Scores of predictions against labels: pairs, classes, calibration, comparison, cluster bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.operators.ingest import unique

CLASSES = ("negative", "neutral", "positive")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def pair_scores(predicted: DataFrame, truth: DataFrame, keys: list[str], by: list[str] | None = None, weight: DataFrame | None = None) -> DataFrame:
    """AG27-28: tp, fp, fn, precision, recall, F1 of two sets of key pairs, by columns of the key, optionally weighted.

    One full outer join of the distinct pairs; a weight is looked up by the first key (1 where absent).
    """
    a = predicted.select(*keys).distinct().withColumn("__p", F.lit(1))
    b = truth.select(*keys).distinct().withColumn("__t", F.lit(1))
    both = a.join(b, keys, "full_outer").select(*keys, F.coalesce("__p", F.lit(0)).alias("p"), F.coalesce("__t", F.lit(0)).alias("t"))
    w = F.lit(1)
    if weight is not None:
        both = both.join(weight.select(keys[0], F.col("weight").alias("__w")), keys[0], "left")
        w = F.coalesce("__w", F.lit(1))
    one = lambda c, name: F.coalesce(F.sum(F.when(c, w)), F.lit(0)).alias(name)
    s = both.groupBy(*(by or [])).agg(one((F.col("p") == 1) & (F.col("t") == 1), "tp"), one((F.col("p") == 1) & (F.col("t") == 0), "fp"), one((F.col("p") == 0) & (F.col("t") == 1), "fn"))
    return scored(s)


def scored(s: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    return s.withColumns({"precision": F.coalesce(ratio(tp, tp + fp), zero), "recall": F.coalesce(ratio(tp, tp + fn), zero), "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero)})


def exact_sets(predicted: DataFrame, truth: DataFrame, key: str, item: str) -> DataFrame:
    """AG27: (reviews, exact): keys with an item on either side, and those whose two sets of items are equal."""
    a = predicted.select(key, item).distinct().withColumn("__p", F.lit(1))
    b = truth.select(key, item).distinct().withColumn("__t", F.lit(1))
    by = a.join(b, [key, item], "full_outer").groupBy(key).agg(F.bool_and(F.col("__p").isNotNull() & F.col("__t").isNotNull()).alias("equal"))
    return by.agg(F.count("*").alias("reviews"), F.count_if("equal").alias("exact"))


def pair_agreement(predicted: DataFrame, truth: DataFrame, keys: list[str], label: str, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """AG29: (given, predicted, n, agree) over the pairs that both sides have with a label of ``classes``; others, as mixed or unclear, do not count."""
    a = predicted.where(F.col(label).isin(*classes)).select(*keys, F.col(label).alias("predicted")).distinct()
    b = truth.where(F.col(label).isin(*classes)).select(*keys, F.col(label).alias("given")).distinct()
    return a.join(b, keys).groupBy("given", "predicted").agg(F.count("*").alias("n")).withColumn("agree", F.col("given") == F.col("predicted"))


def confusion(rows: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """AG29-30: counts by label and prediction."""
    return rows.groupBy(*(by or []), label, predicted).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """AG30: by class tp, fp, fn, support and scores, from the confusion counts (nine rows, whatever the data)."""
    c = confusion(rows, label, predicted)
    sides = c.select(F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit("t").alias("side")), F.struct(F.col(predicted).alias("class"), F.lit("p").alias("side")))).alias("x"), (F.col(label) == F.col(predicted)).alias("hit"), "n").select("x.*", "hit", "n")
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long").alias(name)
    s = sides.groupBy("class").agg(total((F.col("side") == "t") & F.col("hit"), "tp"), total((F.col("side") == "p") & ~F.col("hit"), "fp"), total((F.col("side") == "t") & ~F.col("hit"), "fn"), total(F.col("side") == "t", "support"))
    return scored(s)


def overall(metrics: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1 of class metrics."""
    return metrics.agg(F.sum("support").cast("long").alias("support"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def error_rates(rows: DataFrame, group: Column, name: str, label: str, predicted: str) -> DataFrame:
    """AG32: errors by group."""
    wrong = F.count_if(F.col(label) != F.col(predicted))
    return rows.groupBy(group.alias(name)).agg(F.count("*").alias("rows"), wrong.alias("errors")).withColumn("error_rate", ratio(F.col("errors"), F.col("rows")))


#: Upper ends and names of the right-closed bins of the token count.
TOKEN_BINS = ((16, "0–16"), (32, "17–32"), (64, "33–64"), (128, "65–128"), (255, "129–255"), (None, "256+"))


def token_bin(n: Column) -> Column:
    """PRJ11: right-closed bins of the token count; null has none."""
    out = F.when(n > TOKEN_BINS[-2][0], TOKEN_BINS[-1][1])
    for end, name in TOKEN_BINS[-2::-1]:
        out = F.when(n <= end, name).otherwise(out)
    return out


def calibration_bins(rows: DataFrame, score: str, label: str, predicted: str, bins: int = 10) -> DataFrame:
    """AG33: equal right-closed bins of the confidence (the first takes 0 too): rows, hits, sum of scores in millionths."""
    s = F.col(score)
    b = F.greatest(F.lit(1), F.ceil(s * bins)).cast("long")
    ok = rows.where(s.isNotNull() & ~F.isnan(s) & s.between(0, 1))
    return ok.groupBy(b.alias("bin")).agg(F.count("*").alias("rows"), F.count_if(F.col(label) == F.col(predicted)).alias("hits"), F.sum(F.floor(s * 1_000_000 + 0.5)).cast("long").alias("score_micro"))


def threshold_rates(rows: DataFrame, score: str, label: str, predicted: str, percents: list[int]) -> DataFrame:
    """AG33: by least score (in percent) the rows that reach it, their errors, share of all rows and error rate, in one pass."""
    s = F.col(score)
    reached = F.filter(F.array(*[F.lit(p) for p in percents]), lambda p: (s >= p / 100.0) & ~F.isnan(s))
    by = rows.select(F.explode(reached).alias("percent"), (F.col(label) != F.col(predicted)).alias("wrong")).groupBy("percent").agg(F.count("*").alias("rows"), F.count_if("wrong").alias("errors"))
    total = rows.agg(F.count("*").alias("all"))
    return by.crossJoin(F.broadcast(total)).withColumns({"coverage": ratio(F.col("rows"), F.col("all")), "error_rate": ratio(F.col("errors"), F.col("rows"))}).drop("all")


def calibration(bins: DataFrame) -> DataFrame:
    """Expected calibration error of the bins."""
    total = F.sum("rows").cast("double")
    return bins.agg(total.cast("long").alias("rows"), (F.sum(F.abs(F.col("hits") - F.col("score_micro") / 1e6)) / total).alias("ece"))


def proper_scores(rows: DataFrame, label: str, scores: dict[str, str], tolerance: float = 1e-4) -> DataFrame:
    """AG33: multiclass Brier score and log-loss; probabilities that do not add up to 1 are an error."""
    total = sum((F.col(c) for c in list(scores.values())[1:]), F.col(next(iter(scores.values()))))
    bad = rows.where(F.abs(total - 1) > tolerance).limit(1).count()
    if bad:
        raise ValueError("the class scores of a row do not add up to 1")
    own, brier = F.lit(None).cast("double"), F.lit(0.0)
    for name, c in scores.items():
        hit = F.col(label) == name
        own = F.when(hit, F.col(c)).otherwise(own)
        brier = brier + F.pow(F.col(c) - hit.cast("double"), 2)
    return rows.agg(F.avg(brier).alias("brier"), F.avg(-F.log(F.greatest(own, F.lit(1e-15)))).alias("log_loss"))


def model_comparison(a: DataFrame, b: DataFrame, key: str, label: str, predicted: str) -> DataFrame:
    """AG34, JN14, PRJ12: rows by who is right: both, only the first, only the second, neither; a key that repeats on either side is an error."""
    unique(a, [key])
    unique(b, [key])
    x = a.select(key, label, F.col(predicted).alias("pa"))
    y = b.select(key, F.col(predicted).alias("pb"))
    right = lambda c: F.col(c) == F.col(label)
    outcome = F.when(right("pa") & right("pb"), "both_right").when(right("pa"), "only_first_right").when(right("pb"), "only_second_right").otherwise("both_wrong")
    return x.join(y, key).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


#: Patterns over text in lower case, and over the text as it is.
POSITIVE = r"\b(?:love|loved|great|excellent|amazing|perfect|wonderful|awesome|fantastic|recommend|works? well|five stars?)\b"
NEGATIVE = r"\b(?:hate|hated|terrible|awful|worst|useless|disappointed|waste of money|does(?:n['’]t| not) work|did(?:n['’]t| not) work|one star)\b"
NEGATED = r"\b(?:not|never|isn['’]t|wasn['’]t|doesn['’]t|didn['’]t)\s+(?:\w+\s+){0,2}(?:good|great|excellent|amazing|perfect|wonderful)\b"
CONTRAST = r"\b(?:but|however|although|though|yet|on the other hand)\b"
DELIVERY = r"\b(?:shipping|delivery|delivered|package|packaging|arrived|seller|amazon|refund|returned?|replacement)\b"
SHOUT = r"\b[A-Z]{4,}\b"
SHORT_TOKENS, MARKS = 8, 2


def error_clues(rows: DataFrame, text: str = "review_text", rating: str = "rating", tokens: str = "token_count") -> DataFrame:
    """TX17: what a text holds that may explain an error; a null text is an empty one."""
    raw = F.coalesce(F.col(text), F.lit(""))
    low, stars = F.lower(raw), F.col(rating)
    good, bad = low.rlike(POSITIVE) & ~low.rlike(NEGATED), low.rlike(NEGATIVE)
    return rows.withColumns({
        "has_positive": good, "has_negative": bad, "mixed_opinion": (good & bad) | low.rlike(CONTRAST), "delivery": low.rlike(DELIVERY),
        "positive_text_low_rating": F.coalesce((stars <= 2) & good & ~bad, F.lit(False)), "negative_text_high_rating": F.coalesce((stars >= 4) & bad & ~good, F.lit(False)),
        "no_clear_sentiment": ~(good | bad), "very_short": F.coalesce(F.col(tokens) <= SHORT_TOKENS, F.lit(False)),
        "strong_emotion": (F.regexp_count(raw, F.lit("!")) >= MARKS) | raw.rlike(SHOUT),
    }).withColumn("text_against_rating", F.col("positive_text_low_rating") | F.col("negative_text_high_rating"))


CLUES = ("has_positive", "has_negative", "mixed_opinion", "delivery", "positive_text_low_rating", "negative_text_high_rating", "no_clear_sentiment", "very_short", "strong_emotion", "text_against_rating")


def clue_errors(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """(clue, rows, errors): how many rows show each clue, and how many of them are predicted wrongly, in one pass."""
    named = error_clues(rows).select(F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in CLUES]))).alias("clue"), (F.col(label) != F.col(predicted)).alias("wrong"))
    return named.groupBy("clue").agg(F.count("*").alias("rows"), F.count_if("wrong").alias("errors"))


def cluster_confusion(rows: DataFrame, cluster: str, label: str, predicted: str) -> DataFrame:
    """One row per cluster with its nine confusion counts: what the bootstrap resamples."""
    cells = [F.count_if((F.col(label) == a) & (F.col(predicted) == b)).alias(f"{a}|{b}") for a in CLASSES for b in CLASSES]
    return rows.groupBy(cluster).agg(*cells)


def bootstrap(rows: DataFrame, cluster: str, label: str, predicted: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """AG31: percentile intervals of accuracy and macro-F1 when clusters are drawn with replacement.

    Distributed: each cluster gets a Poisson(1) weight for every round from a hash of its id, tasks
    add up weighted confusion counts for all rounds at once, and only rounds x 9 numbers come to the driver.
    """
    table = cluster_confusion(rows, cluster, label, predicted)
    cells = [f"{a}|{b}" for a in CLASSES for b in CLASSES]

    def partial(batches):
        total = np.zeros((rounds, 9))
        for pdf in batches:
            m = pdf[cells].to_numpy(float)
            for k, own in zip(pdf["__h"], m):
                total += np.random.default_rng([seed, int(k) & 0x7FFFFFFFFFFFFFFF]).poisson(1.0, rounds)[:, None] * own
        out = pd.DataFrame(total, columns=[f"c{i}" for i in range(9)])
        out["round"] = range(rounds)
        yield out

    schema = ", ".join(f"c{i} double" for i in range(9)) + ", round int"
    named = table.select(F.xxhash64(cluster).alias("__h"), *[F.col(f"`{c}`") for c in cells])
    sums = named.mapInPandas(partial, schema).groupBy("round").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(9)]).toPandas()
    m = sums[[f"c{i}" for i in range(9)]].to_numpy().reshape(-1, 3, 3)
    total = m.sum(axis=(1, 2))
    m = m[total > 0]
    accuracy = np.trace(m, axis1=1, axis2=2) / m.sum(axis=(1, 2))
    hit = np.diagonal(m, axis1=1, axis2=2)
    base = m.sum(axis=2) + m.sum(axis=1)
    f1 = np.divide(2 * hit, base, out=np.zeros_like(base), where=base > 0).mean(axis=1)
    out = [(n, float(np.percentile(v, 2.5)), float(np.percentile(v, 97.5))) for n, v in (("accuracy", accuracy), ("macro_f1", f1)) if len(v)]
    return rows.sparkSession.createDataFrame(out, "metric string, low double, high double")
