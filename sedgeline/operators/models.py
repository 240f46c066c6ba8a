"""Text classifiers and latent vectors on Spark's own learners."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.functions.spans import aspect_context
from sedgeline.operators.sampling import fold
from sedgeline.operators.search import STOP
from sedgeline.session import cut, drop_cut, width


def tfidf_pipeline(text: str, label: str, terms: int = 100_000, least_df: int = 5, penalty: float = 1.0) -> Pipeline:
    """ML4: word 1-2 grams in one vocabulary, inverse document frequencies, rows of length 1, multinomial logistic regression.

    ``penalty`` is the regularisation strength (the inverse of the usual C). The vocabulary is bounded by ``terms``.
    """
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"\b\w\w+\b", gaps=False, toLowercase=True),
            NGram(n=2, inputCol="__w", outputCol="__b"),
            SQLTransformer(statement="SELECT *, concat(__w, __b) AS __t FROM __THIS__"),
            CountVectorizer(inputCol="__t", outputCol="__c", vocabSize=terms, minDF=least_df),
            IDF(inputCol="__c", outputCol="__i"),
            Normalizer(inputCol="__i", outputCol="features"),
            StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="skip"),
            LogisticRegression(featuresCol="features", labelCol="__y", family="multinomial", regParam=penalty, maxIter=60),
        ]
    )


def train(rows: DataFrame, text: str, label: str, least_df: int = 5, penalty: float = 0.02) -> PipelineModel:
    """The fitted pipeline; the texts are cut once, as each stage reads them again."""
    held = cut(rows.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(text, label))
    model = tfidf_pipeline(text, label, least_df=least_df, penalty=penalty).fit(held)
    drop_cut(held)
    return model


def predict(model: PipelineModel, rows: DataFrame, text: str, label: str) -> DataFrame:
    """Predictions with the score of every class; rows without text get the prediction of an empty one."""
    names = next(s for s in model.stages if hasattr(s, "labels")).labels
    body = PipelineModel([s for s in model.stages if not hasattr(s, "labels")])
    out = body.transform(rows.withColumn(text, F.coalesce(text, F.lit(""))))
    p = vector_to_array("probability")
    out = out.withColumns({f"score_{n}": p[i] for i, n in enumerate(names)} | {"predicted_label": F.element_at(F.array(*map(F.lit, names)), F.col("prediction").cast("int") + 1)})
    return out.drop("__w", "__b", "__t", "__c", "__i", "features", "rawPrediction", "probability", "prediction").withColumn("model_score", F.greatest(*[F.col(f"score_{n}") for n in names]))


def select_penalty(rows: DataFrame, text: str, label: str, penalties: list[float], validation: DataFrame, least_df: int = 5) -> tuple[float, PipelineModel]:
    """The penalty with the best macro-F1 on the validation rows, and its model."""
    from sedgeline.operators.evaluation import class_metrics

    best = None
    for p in penalties:
        m = train(rows, text, label, least_df, p)
        f1 = class_metrics(predict(m, validation, text, label), label, "predicted_label").agg(F.avg("f1")).first()[0] or 0.0
        if best is None or f1 > best[0]:
            best = (f1, p, m)
    return best[1], best[2]


@F.pandas_udf(T.ArrayType(T.StringType()))
def char_grams(text: pd.Series) -> pd.Series:
    """ML5: character 3-5 grams within words, each word padded by a blank; the grams of a word are formed once a batch."""
    known: dict[str, list[str]] = {}

    def grams(word: str) -> list[str]:
        if word not in known:
            w = f" {word} "
            known[word] = [w[i : i + n] for n in (3, 4, 5) for i in range(max(1, len(w) - n + 1))]
        return known[word]

    return text.map(lambda t: [g for w in (t or "").lower().split() for g in grams(w)])


def aspect_model(rows: DataFrame, aspects: list[str], text: str = "text", labels: str = "labels", least_df: int = 2, features: int = 75_000, penalty: float = 0.01) -> tuple[PipelineModel, dict[str, object]]:
    """ML5: one binary regression per aspect over shared character-gram TF-IDF features; ``labels`` is array<string>."""
    base = rows.withColumn("__g", char_grams(F.coalesce(text, F.lit(""))))
    shared = Pipeline(stages=[CountVectorizer(inputCol="__g", outputCol="__c", vocabSize=features, minDF=least_df), IDF(inputCol="__c", outputCol="features")]).fit(base)
    ready = shared.transform(base).select("features", labels).persist()
    own = {}
    try:
        for a in aspects:
            y = ready.withColumn("__y", F.array_contains(labels, a).cast("double"))
            if y.select("__y").distinct().count() == 2:
                own[a] = LogisticRegression(featuresCol="features", labelCol="__y", regParam=penalty, maxIter=40).fit(y)
    finally:
        ready.unpersist()
    return shared, own


def predict_aspects(model: tuple[PipelineModel, dict], rows: DataFrame, key: str = "review_id", text: str = "text", threshold: float = 0.45) -> DataFrame:
    """ML6 (model side): (key, aspect_id, probability) from ``threshold`` on."""
    shared, own = model
    ready = shared.transform(rows.withColumn("__g", char_grams(F.coalesce(text, F.lit("")))))
    scored = []
    for a, m in sorted(own.items()):
        ready = m.transform(ready).withColumn(f"__p{len(scored)}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
        scored.append(F.struct(F.lit(a).alias("aspect_id"), F.col(f"__p{len(scored)}").alias("probability")))
    if not scored:
        return rows.sparkSession.createDataFrame([], f"{key} string, aspect_id string, probability double")
    return ready.select(key, F.explode(F.array(*scored)).alias("x")).select(key, "x.*").where(F.col("probability") >= threshold)


def out_of_fold(rows: DataFrame, aspects: list[str], group: str = "parent_asin", k: int = 5, **kw) -> DataFrame:
    """ML5, SMP11: predictions of each fold by a model of the others; a product never stands on both sides."""
    folded = rows.withColumn("__fold", fold(group, k))
    out = None
    for i in range(k):
        m = aspect_model(folded.where(F.col("__fold") != i), aspects, **kw)
        p = predict_aspects(m, folded.where(F.col("__fold") == i))
        out = p if out is None else out.unionByName(p)
    return out


def hybrid_mentions(alias: DataFrame, model: DataFrame) -> DataFrame:
    """SET5, ML6: mentions of either source with their sources; keys review_id and aspect_id."""
    a = alias.select("review_id", "aspect_id", F.lit("alias").alias("__a")).distinct()
    m = model.select("review_id", "aspect_id", "probability")
    both = a.join(m, ["review_id", "aspect_id"], "full_outer")
    sources = F.array_compact(F.array(F.col("__a"), F.when(F.col("probability").isNotNull(), "model")))
    return both.select("review_id", "aspect_id", "probability", sources.alias("sources"))


def score_contexts(model: PipelineModel, mentions: DataFrame, reviews: DataFrame, label: str = "label") -> DataFrame:
    """ML8: the sentiment of every mention (review_id, aspect_id, evidence) from the sentences that hold its evidence.

    ``evidence`` is array<struct<text,start,end>> over the review's text; offsets that do not give their
    text are an error. Spark's batches take the place of a separate batched form: both are this plan.
    """
    own = mentions.join(reviews.select("review_id", "text"), "review_id")
    spans = F.transform("evidence", lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["text"].alias("text")))
    context = own.withColumn("aspect_context", aspect_context("text", spans)).drop("text")
    scored = predict(model, context.withColumnRenamed("aspect_context", "text"), "text", label)
    return scored.withColumnRenamed("text", "aspect_context").withColumnRenamed("predicted_label", "aspect_sentiment").withColumnRenamed("model_score", "aspect_sentiment_score")


#: Terms and components of a latent space; directions kept beside them and passes while its axes are sought.
LATENT_TERMS, LATENT_SIZE, LATENT_SPARE, LATENT_PASSES = 30_000, 128, 32, 7
#: Rows of a block of the term matrix, directions that a job multiplies, and sums of these that the driver takes at once.
LATENT_BLOCK, LATENT_COLUMNS, LATENT_DIRECT = 512, 32, 16
_LATENT_WORD, _LATENT_STOP = re.compile(r"\b\w\w+\b"), frozenset(STOP)


def latent_terms(text: str | None) -> Counter:
    """Words of two or more letters or digits of any script without stop words, and pairs of neighbours, with their frequency."""
    w = [x for x in _LATENT_WORD.findall(text.lower()) if x not in _LATENT_STOP] if text else []
    return Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:]))


def latent_vocabulary(rows: DataFrame, text: str, terms: int, least_df: int, most_share: float) -> tuple[int, dict[str, tuple[int, float]]]:
    """(texts, {term: (place, inverse document frequency)}): the most frequent terms within the document-frequency bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), LATENT_BLOCK):
                n, df = Counter(), Counter()
                for t in pdf["t"].iloc[i : i + LATENT_BLOCK]:
                    own = latent_terms(t)
                    n.update(own)
                    df.update(own.keys())
                n[""] = df[""] = len(pdf["t"].iloc[i : i + LATENT_BLOCK])  # no term is empty: the number of texts
                yield pd.DataFrame({"term": list(n), "n": list(n.values()), "df": [df[x] for x in n]})

    texts = rows.select(F.col(text).alias("t")).where(F.length(F.trim("t")) >= 2)
    counted = cut(texts.mapInPandas(run, "term string, n long, df long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).where((F.col("df") >= least_df) | (F.col("term") == "")))
    total = counted.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counted.where((F.col("term") != "") & (F.col("df") <= most_share * total)).orderBy(F.col("n").desc(), "term").limit(terms).collect()
    return total, {r["term"]: (i, float(np.log((1 + total) / (1 + r["df"])) + 1)) for i, r in enumerate(sorted(top, key=lambda r: r["term"]))}


def latent_row(text: str | None, known: dict[str, tuple[int, float]]) -> tuple[list[int], np.ndarray]:
    """Places and TF-IDF weights of a text's known terms, scaled to length 1."""
    at, w = [], []
    for t, n in latent_terms(text).items():
        x = known.get(t)
        if x:
            at.append(x[0])
            w.append((1 + math.log(n)) * x[1])
    v = np.array(w, np.float32)
    return at, v / np.linalg.norm(v) if at else v


def latent_blocks(rows: DataFrame, key: str, text: str, known: dict[str, tuple[int, float]]) -> DataFrame:
    """(keys, sizes, at, w): the TF-IDF rows of all texts, a block a row; a text without a known term has size 0."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), LATENT_BLOCK):
                part = pdf.iloc[i : i + LATENT_BLOCK]
                own = [latent_row(t, shared.value) for t in part["t"]]
                at, w = np.array([x for r, _ in own for x in r], np.uint32), np.concatenate([v for _, v in own]).astype(np.float32)
                yield pd.DataFrame([{"keys": list(part["k"]), "sizes": np.array([len(r) for r, _ in own], np.int32).tobytes(), "at": at.tobytes(), "w": w.tobytes()}])

    found = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).repartition(width(spark))
    blocks = cut(found.mapInPandas(run, f"keys array<{found.schema['k'].dataType.simpleString()}>, sizes binary, at binary, w binary"))
    shared.destroy()
    return blocks


def latent_sums(sizes: bytes, at: bytes, w: bytes, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A q, rows, places, weights) of the rows of a block that have terms."""
    n, at, w = np.frombuffer(sizes, np.int32), np.frombuffer(at, np.uint32), np.frombuffer(w, np.float32)
    rows = np.flatnonzero(n)
    y = np.add.reduceat(q[at] * w[:, None], (np.cumsum(n) - n)[rows], axis=0) if len(rows) else np.zeros((0, q.shape[1]), np.float32)
    return y, rows, at, w


def latent_product(sizes: bytes, at: bytes, w: bytes, q: np.ndarray, into: np.ndarray) -> None:
    """Adds A'(A q) of a block A to ``into``."""
    y, rows, at, w = latent_sums(sizes, at, w, q)
    if len(rows):
        row = np.repeat(np.arange(len(rows)), np.frombuffer(sizes, np.int32)[rows])
        order = np.argsort(at, kind="stable")
        term, first = np.unique(at[order], return_index=True)
        into[term] += np.add.reduceat(y[row[order]] * w[order, None], first, axis=0)


def latent_axes(blocks: DataFrame, terms: int, size: int, seed: int) -> np.ndarray:
    """(terms x size): the first right singular vectors of the TF-IDF matrix of all rows, by subspace iteration.

    Every pass reads the whole matrix, held in blocks, for a few directions at a time; a task adds up its
    blocks, so what goes back is of one size a task whatever the number of rows.
    """
    spark = blocks.sparkSession
    parts = spark.sparkContext.defaultParallelism
    blocks = blocks.drop("keys").coalesce(parts)
    shape = terms, min(terms, size + LATENT_SPARE)

    def product(q: np.ndarray) -> np.ndarray:
        """A'(A q) over all blocks."""
        held = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            z, found = np.zeros(q_shape, np.float32), False
            for pdf in batches:
                for sizes, at, w in zip(pdf["sizes"], pdf["at"], pdf["w"]):
                    latent_product(sizes, at, w, held.value, z)
                    found = True
            if found:
                yield pd.DataFrame({"part": [0], "z": [z.tobytes()]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [0], "z": [sum(np.frombuffer(x, np.float32) for x in pdf["z"]).astype(np.float32).tobytes()]})

        q_shape = q.shape
        sums = blocks.mapInPandas(run, "part int, z binary")
        if parts > LATENT_DIRECT:
            sums = sums.withColumn("part", F.spark_partition_id() % LATENT_DIRECT).groupBy("part").applyInPandas(add, "part int, z binary")
        z = np.zeros(q_shape, np.float32)
        for x in sums.select("z").toArrow()["z"]:
            z += np.frombuffer(x.as_buffer(), np.float32).reshape(q_shape)
        held.destroy()
        return z

    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal(shape, np.float32))
    for _ in range(LATENT_PASSES):
        z = np.hstack([product(np.ascontiguousarray(q[:, i : i + LATENT_COLUMNS])) for i in range(0, shape[1], LATENT_COLUMNS)])
        h = (q.T @ z).astype(np.float64)
        last, (q, _) = q, np.linalg.qr(z)
    _, u = np.linalg.eigh((h + h.T) / 2)
    return (last @ u[:, ::-1][:, :size]).astype(np.float32)


def lsa_vectors(rows: DataFrame, key: str, text: str, size: int = LATENT_SIZE, seed: int = 42, terms: int = LATENT_TERMS, least_df: int = 1, most_share: float = 1.0) -> DataFrame:
    """ML10: (key, embedding): a latent vector of every row, scaled to length 1; zeros where a row has no known term.

    Vocabulary and axes come from all rows: the ``terms`` most frequent words and word pairs found in at least ``least_df``
    rows and at most ``most_share`` of them, and the first ``size`` singular vectors of their TF-IDF weights.
    """
    spark = rows.sparkSession
    total, known = latent_vocabulary(rows, text, terms, least_df, most_share)
    k = min(size, max(2, total - 1), max(2, len(known) - 1), len(known))
    blocks = latent_blocks(rows, key, text, known)
    axes = spark.sparkContext.broadcast(latent_axes(blocks, len(known), k, seed) if known else np.zeros((0, size), np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for keys, sizes, at, w in zip(pdf["keys"], pdf["sizes"], pdf["at"], pdf["w"]):
                y, full, _, _ = latent_sums(sizes, at, w, axes.value)
                v, norm = np.zeros((len(keys), axes.value.shape[1])), np.linalg.norm(y, axis=1, keepdims=True)
                v[full] = np.divide(y, norm, out=np.zeros_like(y), where=norm > 1e-6)
                yield pd.DataFrame({"k": list(keys), "embedding": list(v)})

    kind = rows.schema[key].dataType.simpleString()
    return blocks.mapInPandas(run, f"k {kind}, embedding array<double>").withColumnRenamed("k", key)
