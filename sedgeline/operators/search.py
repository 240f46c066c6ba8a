"""Lexical and vector retrieval, vocabularies, evidence and context selection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.session import cut

#: Common English words that carry no topic (fixed values).
STOP = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()


def words(text: Column) -> Column:
    """Runs of two or more ASCII letters, digits and underscores, in lower case, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP))


def grams(df: DataFrame, key: str, text: str, most: int = 2) -> DataFrame:
    """(id, term, tf): word n-grams of 1 to ``most`` words with their frequency, formed in the JVM."""
    w = words(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(F.col(key).alias("id"), w.alias("w"))
    terms = F.col("w")
    for n in range(2, most + 1):
        terms = F.concat(terms, _ngrams(n))
    return rows.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def _ngrams(n: int) -> Column:
    at = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    return F.when(F.size("w") >= n, at).otherwise(F.array().cast("array<string>"))


def tfidf_vectors(tf: DataFrame, documents: int | None = None) -> DataFrame:
    """ML2: (id, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document scaled to length 1.

    n is ``documents``, or the number of documents with a term.
    """
    n = tf.agg(F.count_distinct("id").alias("n") if documents is None else F.lit(documents).alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    raw = tf.join(df, "term").crossJoin(F.broadcast(n))
    raw = raw.select("id", "term", ((1 + F.log("tf")) * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1)).alias("v"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norms, "id").select("id", "term", (F.col("v") / F.col("norm")).alias("weight"))


def cosine_to(vectors: DataFrame, is_query: Column) -> DataFrame:
    """(id, score): cosine of every other document with the query, by a join on its few terms."""
    q = vectors.where(is_query).select("term", F.col("weight").alias("q"))
    return vectors.where(~is_query).join(q, "term").groupBy("id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))


def cosines_of(vectors: DataFrame, is_query: Column) -> DataFrame:
    """(query_id, id, score): cosine of every query with every other document that shares a term with it."""
    q = vectors.where(is_query).select(F.col("id").alias("query_id"), "term", F.col("weight").alias("q"))
    return vectors.join(q, "term").where("id <> query_id").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))


def similar_documents(df: DataFrame, key: str, text: str, query_id, k: int = 20) -> DataFrame:
    """TK6 over ML2: the ``k`` documents nearest to one of them, by score then id."""
    scored = cosine_to(tfidf_vectors(grams(df, key, text)), F.col("id") == F.lit(query_id))
    return scored.orderBy(F.col("score").desc(), "id").limit(k)


def phrase_words(text: Column) -> Column:
    """Words of two characters or more that begin with a letter, with inner apostrophes, in lower case, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-z][a-z']+\b"), 0), lambda w: ~w.isin(STOP))


def vocabulary(df: DataFrame, segment: str, text: str, least: int = 5, least_share: float = 0.0005, most_share: float = 0.95, features: int = 10_000, top: int = 150, sizes: int = 3) -> DataFrame:
    """ML3, TK7: by segment the phrases of one to ``sizes`` words that stand in most documents, with their document frequency and share.

    A phrase needs max(least, least_share x documents) documents and at most ``most_share`` of them; of
    these the ``features`` most frequent make the vocabulary and the ``top`` first are given. Each document's distinct
    phrases go straight to counts by phrase, combined map-side.
    """
    docs = df.where(F.col(segment).isNotNull()).select(F.col(segment), phrase_words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    terms = F.col("w")
    for n in range(2, sizes + 1):
        terms = F.concat(terms, _ngrams(n))
    freq = docs.select(segment, F.explode(F.array_distinct(terms)).alias("term")).groupBy(segment, "term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    total = docs.groupBy(segment).agg(F.count("*").alias("docs"))
    kept = freq.join(total, segment).where((F.col("df") <= most_share * F.col("docs")) & (F.col("df") >= F.floor(F.col("docs") * least_share)))
    w = Window.partitionBy(segment).orderBy(F.col("df").desc(), "term")
    return kept.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= min(top, features)).select(segment, "place", "term", "df", (F.col("df").cast("double") / F.col("docs")).alias("share"))


def vector_topk(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", column: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """ML11, TK6: the ``k`` vectors of greatest cosine with the query; each task keeps its k best."""
    if allowed is not None:
        vectors = vectors.join(allowed.select(key).distinct(), key, "left_semi")
    q = F.array(*[F.lit(float(x)) for x in query])
    size = sum(x * x for x in query) ** 0.5
    add = lambda acc, x: acc + x
    v = F.transform(column, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), add)
    norm = F.sqrt(F.aggregate(F.transform(v, lambda a: a * a), F.lit(0.0), add))
    return vectors.select(key, F.try_divide(dot, norm * F.lit(size)).alias("score")).orderBy(F.col("score").desc_nulls_last(), key).limit(k)


#: Vectors of a block that meets the blocks of the other side.
VECTOR_BLOCK = 2048


def vector_blocks(vectors: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """(name, name_keys, name_vectors): vectors scaled to length 1 in blocks; null and zero vectors have no direction and are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for i in range(0, len(pdf), VECTOR_BLOCK):
                own = pdf.iloc[i : i + VECTOR_BLOCK]
                v = np.stack([np.asarray(x, np.float64) for x in own["v"]])
                norm = np.sqrt((v * v).sum(axis=1))
                keep = norm > 0
                if keep.any():
                    yield pd.DataFrame([{name: (part << 24) + number, f"{name}_keys": list(own["k"][keep]), f"{name}_vectors": (v[keep] / norm[keep, None]).tobytes()}])
                number += 1

    own = vectors.select(F.col(key).alias("k"), F.col(column).alias("v")).where("v is not null")
    kind = own.schema["k"].dataType.simpleString()
    return cut(own.mapInPandas(run, f"{name} long, {name}_keys array<{kind}>, {name}_vectors binary"))


def vectors_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """ML11, TK6 for a set of queries: (query_id, key, score, place): the ``k`` vectors of greatest cosine with each.

    Blocks of queries meet blocks of vectors, every pair a unit of its own that keeps the k best of each
    query; what the product cannot tell apart is scored again one by one, so that equal vectors tie exactly.
    """
    kind = vectors.schema[key].dataType.simpleString()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        qk, rk = np.asarray(r["q_keys"]), np.asarray(r["r_keys"])
        q, v = (np.frombuffer(r[x], np.float64).reshape(len(n), -1) for x, n in (("q_vectors", qk), ("r_vectors", rk)))
        dots, out = q @ v.T, []
        for i in range(len(qk)):
            at = np.flatnonzero(dots[i] >= np.partition(dots[i], -k)[-k] - 1e-9) if len(rk) > k else np.arange(len(rk))
            score = (v[at] * q[i]).sum(axis=1)
            best = np.lexsort((rk[at], -score))[:k]
            out.append(pd.DataFrame({"query_id": qk[i], key: rk[at[best]], "score": score[best]}))
        return pd.concat(out)

    pairs = vector_blocks(vectors, key, column, "r").crossJoin(vector_blocks(queries, key, column, "q"))
    few = pairs.groupBy("q", "r").applyInPandas(meet, f"query_id {kind}, {key} {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)).cast("long")
    return few.withColumn("place", place).where(F.col("place") <= k)


def best_aspects(mentions: DataFrame) -> DataFrame:
    """WIN13: of every review the mention of greatest probability, of equal ones the first aspect; unknown probabilities do not count."""
    p = mentions.where(F.col("probability").isNotNull() & ~F.isnan("probability"))
    w = Window.partitionBy("review_id").orderBy(F.col("probability").desc(), "aspect_id")
    return p.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def evidence(mentions: DataFrame, reviews: DataFrame, aspect: str, negative: bool, per_product: int = 2, k: int = 10) -> DataFrame:
    """WIN13-14, PRJ17: reviews that show an aspect, by probability then votes then id; ``retrieve`` ranks them by a query (ML13).

    One row per review and per normalised text, at most ``per_product`` of a product; the greedy
    choice of the definition equals a rank within the product before the limit.
    """
    band = F.col("rating") <= 2 if negative else F.col("rating") >= 4
    own = mentions.where((F.col("aspect_id") == aspect) & band & F.col("probability").isNotNull() & ~F.isnan("probability")).select("review_id", "parent_asin", "probability", "helpful")
    rows = own.join(reviews.select("review_id", F.md5(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("key")), "review_id")
    order = [F.col("probability").desc(), F.col("helpful").desc(), F.col("review_id")]
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("rn = 1")
    few = first.withColumn("rn", F.row_number().over(Window.partitionBy("parent_asin").orderBy(*order))).where(F.col("rn") <= per_product)
    return few.orderBy(*order).limit(k).select("review_id", "parent_asin", "helpful")


def phrases_of(evidence: str) -> Column:
    """JS1: the texts of an evidence document, in order; null where it cannot be read."""
    return F.transform(F.from_json(evidence, "array<struct<text:string>>"), lambda e: e["text"])


def retrieve(mentions: DataFrame, reviews: DataFrame, query: str, aspect: str | None = None, sentiment: str | None = None, products: list[str] | None = None, k: int = 8, per_product: int = 2, dense: DataFrame | None = None, terms: int = 50_000) -> DataFrame:
    """ML13, MA3, WIN13-14: the reviews that answer a query best, at most ``per_product`` of a product.

    ``mentions`` (review_id, aspect_id, sentiment, probability, evidence) are narrowed to ``aspect`` and ``sentiment``; each review
    enters with its likeliest aspect, each normalised text once. The lexical score is the TF-IDF cosine of
    query and review over the ``terms`` most frequent terms; ``dense`` is (review_id, dense_score). Reviews that
    neither score finds drop out. The retrieval score is 0.80 lexical + 0.15 probability + 0.05 votes, or with
    dense scores 0.55 lexical + 0.25 dense + 0.15 probability + 0.05 votes.
    """
    plain = lambda t: F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))
    asked = " ".join(re.findall("[a-z0-9]+", query.lower()))
    if len(asked) < 2:
        raise ValueError("a query needs two letters or digits")
    if k < 1 or per_product < 1:
        raise ValueError("k and per_product must be positive")
    if sentiment not in (None, "negative", "neutral", "positive"):
        raise ValueError(f"unknown sentiment {sentiment!r}")
    own = mentions.withColumn("probability", F.nanvl(F.col("probability").cast("double"), F.lit(None).cast("double")))
    own = own if aspect is None else own.where(F.col("aspect_id") == aspect)
    own = own if sentiment is None else own.where(F.col("sentiment") == sentiment)
    likely = [F.col("probability").desc_nulls_last(), F.col("aspect_id")]
    best = own.withColumn("rn", F.row_number().over(Window.partitionBy("review_id").orderBy(*likely))).where("rn = 1").select("review_id", "aspect_id", "sentiment", "probability", "evidence")
    scoped = reviews if products is None else reviews.where(F.col("parent_asin").isin(products))
    texts = best.join(scoped.select("review_id", "parent_asin", "rating", "ts", "helpful", "text"), "review_id").withColumn("plain", plain(F.col("text"))).where(F.length("plain") >= 2)
    once = F.row_number().over(Window.partitionBy(F.md5("plain")).orderBy(*likely, "review_id"))
    found = cut(texts.withColumn("rn", once).where("rn = 1").drop("rn"))
    spark = found.sparkSession
    documents = found.select(F.concat(F.lit("r"), "review_id").alias("id"), "plain").unionByName(spark.createDataFrame([("q", asked)], "id string, plain string"))
    tf = cut(grams(documents, "id", "plain"))
    kept = tf.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.col("n").desc(), "term").limit(terms).select("term")
    vectors = tfidf_vectors(tf.join(kept, "term", "left_semi"), found.count() + 1)
    lexical = cosine_to(vectors, F.col("id") == "q").select(F.substring("id", 2, 1 << 30).alias("review_id"), F.col("score").alias("lexical_score"))
    near = spark.createDataFrame([], "review_id string, dense_score double") if dense is None else dense.select("review_id", F.nanvl(F.col("dense_score").cast("double"), F.lit(0.0)).alias("dense_score"))
    clip = lambda x: F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    scored = found.join(lexical, "review_id", "left").join(near, "review_id", "left").withColumns({"lexical_score": F.coalesce("lexical_score", F.lit(0.0)), "dense_score": clip(F.col("dense_score"))})
    scored = cut(scored.where("lexical_score > 0 or dense_score > 0").withColumn("helpful", F.coalesce("helpful", F.lit(0))))
    most = scored.agg(F.log1p(F.greatest(F.lit(1), F.max("helpful"))).alias("most"))
    parts = [(0.80, F.col("lexical_score"))] if dense is None else [(0.55, F.col("lexical_score")), (0.25, F.col("dense_score"))]
    parts += [(0.15, clip(F.col("probability"))), (0.05, F.log1p(F.greatest("helpful", F.lit(0))) / F.col("most"))]
    score = sum((F.lit(w) * x for w, x in parts[1:]), F.lit(parts[0][0]) * parts[0][1])
    order = [F.col("retrieval_score").desc(), F.col("helpful").desc(), F.col("review_id")]
    ranked = scored.crossJoin(F.broadcast(most)).withColumn("retrieval_score", score)
    few = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("parent_asin").orderBy(*order))).where(F.col("rn") <= per_product)
    phrases = phrases_of("evidence").alias("evidence_phrases")
    method = F.lit("lexical_tfidf_v1" if dense is None else "hybrid_tfidf_lsa_v1").alias("retrieval_method")
    return few.orderBy(*order).limit(k).select("review_id", "parent_asin", "rating", "ts", "text", "aspect_id", "sentiment", "probability", phrases, "helpful", "lexical_score", "dense_score", "retrieval_score", method)


def context_budget(ranked: DataFrame, order: list[Column], text: str, budget: int = 12_000, most: int = 8) -> DataFrame:
    """LM8: the first ranked texts whose running length keeps within the budget, numbered for citation."""
    few = ranked.orderBy(*order).limit(most)
    w = Window.partitionBy().orderBy(*order)
    upto = few.withColumn("place", F.row_number().over(w).cast("long")).withColumn("upto", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return upto.where(F.col("upto") <= budget).withColumn("citation", F.format_string("[R%d]", F.col("place")))


def citations(answer: str, known: set[str]) -> list[str]:
    """TX24: the ids cited in square brackets, in order; an unknown one is an error."""
    found = [x.strip() for x in re.findall(r"\[([^\[\]]+)\]", answer)]
    unknown = [x for x in found if x not in known]
    if unknown:
        raise ValueError(f"unknown citations: {unknown}")
    return list(dict.fromkeys(found))


def route(question: str, triggers: dict[str, list[str]], negative: list[str], positive: list[str]) -> tuple[str | None, str | None]:
    """TX23: (aspect, sentiment) of a question: the aspect of the most specific trigger it holds, most words first."""
    q = " " + " ".join(question.lower().replace("?", " ").replace(",", " ").split()) + " "
    hits = [(len(t.split()), len(t), a) for a, ts in triggers.items() for t in ts if f" {t.lower()} " in q]
    aspect = max(hits, key=lambda h: (h[0], h[1], h[2]))[2] if hits else None
    bad, good = any(f" {w} " in q for w in negative), any(f" {w} " in q for w in positive)
    return aspect, "negative" if bad and not good else "positive" if good and not bad else None
