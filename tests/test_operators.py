"""Operators on small hand-written tables."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sedgeline.functions import spans
from sedgeline.functions.text import bucket100, clean_text, fingerprint, id_upper, spreadsheet_safe, split_key, word_count
from sedgeline.operators import aspects, catalog, compare, evaluation, ingest, profile, sampling, search, skew
from sedgeline.operators.selection import smallest_hashes


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# ---------------------------------------------------------------- text


def test_text_columns(spark):
    df = spark.createDataFrame([(" <b>A  b</b>\n\x1cc ", " ab　 ", "Test-Product ", "=x"), (None, "", "", None)], "t string, i string, s string, f string")
    got = df.select(clean_text("t"), id_upper("i"), split_key("s"), spreadsheet_safe("f")).collect()
    assert tuple(got[0]) == ("A b c", "AB", "test_product", "'=x")
    assert tuple(got[1]) == ("", None, None, None)


def test_md5_bucket_is_little_endian(spark):
    df = spark.createDataFrame([("B000000001",)], "p string")
    assert one(df, bucket100("p")) == [(10846349019773430396 % 100,)]


def test_word_count_and_fingerprint(spark):
    df = spark.createDataFrame([("a  b\tc",), ("A b c",)], "t string")
    assert one(df, word_count("t")) == [(3,), (3,)]
    assert len({r[0] for r in one(df, fingerprint("t"))}) == 1


# ---------------------------------------------------------------- ingest


def raw(spark, rows):
    return spark.createDataFrame(rows, "source_record_index long, rating string, title string, text string, asin string, parent_asin string, user_id string, timestamp string, helpful_vote string, verified_purchase string")


def test_transform_reasons_and_coercion(spark):
    ms = "1672531200000"
    df = ingest.transform(raw(spark, [(10, "5", "<b>Good</b>", " hair ", "A", "P", None, ms, "3", "true"), (11, "7", "x", "y", "A", "P", None, ms, "1.5", "yes"), (12, "4", "x", "y", "A", " ", None, ms, "-1", None), (13, "4", "", None, "A", "P", None, ms, "2147483648", "false"), (14, "4", "x", "y", "A", "P", None, "1" + "0" * 40, None, "false")]), "v1", "c", "2023-01-01", "2023-12-31")
    got = {r["source_record_index"]: r for r in df.collect()}
    assert got[10]["review_id"] == "v1:review:000000010" and got[10]["review_text"] == "Good hair" and got[10]["helpful_vote"] == 3
    assert got[10]["review_timestamp"] == dt.datetime(2023, 1, 1) or got[10]["review_timestamp"].timestamp() == 1672531200
    assert [got[i]["drop_reason"] for i in range(10, 15)] == [None, "invalid_rating", "missing_parent_asin", "empty_review_text", "invalid_timestamp"]
    assert [got[i]["helpful_vote"] for i in (11, 12, 13, 14)] == [None] * 4
    assert got[11]["invalid_helpful_vote"] and got[11]["invalid_verified_purchase"] and not got[14]["invalid_helpful_vote"]
    n = {r["measure"]: r["n"] for r in ingest.quality(df).collect()}
    assert n["input"] == n["valid"] + sum(v for k, v in n.items() if k.startswith("drop:"))


def test_deduplicate_null_user_is_a_key(spark):
    rows = [(i, None if i < 2 else "u", "A", 5.0, "same", f"r{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "source_record_index long, user_id string, asin string, rating float, review_text string, review_id string").withColumn("review_timestamp", F.lit("2023-01-01").cast("timestamp"))
    assert sorted(r["review_id"] for r in ingest.deduplicate(df).collect()) == ["r0", "r2"]


def test_checks_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="repeats"):
        ingest.checked_join(df, df, ["k"])
    with pytest.raises(ValueError, match="schema"):
        ingest.same_schema(df, ingest.RAW)


def test_labels_are_strict(spark):
    df = spark.createDataFrame([(r,) for r in (1, 3, 5)], "r int")
    assert [x[0] for x in one(df, profile.sentiment_label(F.col("r")))] == ["negative", "neutral", "positive"]
    assert [x[0] for x in one(df, profile.attention_label(F.col("r")))] == ["needs_attention", "needs_attention", "satisfied"]
    for bad in (6, None):
        with pytest.raises(Exception, match="no attention class"):
            spark.createDataFrame([(bad,)], "r int").select(profile.attention_label(F.col("r"))).collect()


# ---------------------------------------------------------------- skewed counts (problem 5)


def catalog_rows(spark, rows):
    return spark.createDataFrame(rows, "parent_asin string, review_count long, review_id string")


def test_wrong_counts(spark):
    products = catalog_rows(spark, [("P1", 2, "x"), ("P1", 2, "x"), ("P2", 1, "x"), ("P3", 0, "x"), ("P4", None, "x"), ("P5", 9, "x"), (None, 3, "x"), (" ", 3, "x")])
    reviews = spark.createDataFrame([(" p1", "a", 9), ("P1 ", "b", 9), ("p1", "b", 9), ("P2", "c", 9), ("P2", "d", 9), (None, "e", 9), ("P5", None, 9), ("P5", "", 9)], "parent_asin string, review_id string, review_count int")
    assert sorted(r[0] for r in skew.wrong_counts(products, reviews).collect()) == ["P2", "P5"]
    counts = {r["parent_asin"]: r["found_count"] for r in skew.review_counts(products, reviews).collect()}
    assert counts == {"P1": 2, "P2": 2, "P3": 0, "P4": 0, "P5": 0}


def test_wrong_counts_empty(spark):
    products, reviews = catalog_rows(spark, []), spark.createDataFrame([], "parent_asin string, review_id string")
    assert skew.wrong_counts(products, reviews).count() == 0
    assert [tuple(r) for r in skew.wrong_counts(catalog_rows(spark, [("P", 1, "")]), reviews).collect()] == [("P",)]


def test_counts_of_a_hot_key(spark):
    hot = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("K"), F.col("id") % 97)).alias("k"), F.col("id").cast("string").alias("m"))
    both = hot.unionByName(hot)
    got = {r["key"]: r["n"] for r in skew.distinct_counts(both, F.col("k"), F.col("m")).collect()}
    assert got["HOT"] == 10_000 and sum(got.values()) == 30_000


# ---------------------------------------------------------------- selection and samples


@pytest.mark.parametrize("parts", [1, 7])
def test_smallest_hashes_equals_sort(spark, parts):
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "a").when(F.col("id") % 7 == 0, None).otherwise("b").alias("g"), F.col("id").cast("string").alias("k")).withColumn("h", F.md5("k")).repartition(parts)
    quotas = spark.createDataFrame([("a", 100), (None, 10_000), ("c", 5), ("b", 0)], "g string, quota long")
    got = smallest_hashes(df, ["g"], "h", "k", quotas).toPandas()
    all_rows = df.toPandas()
    want = pd.concat([all_rows[all_rows.g == "a"].sort_values("h").head(100), all_rows[all_rows.g.isna()]])
    assert sorted(got.k) == sorted(want.k)
    share = smallest_hashes(df, ["g"], "h", "k", permille=15).toPandas()
    assert {str(k): len(v) for k, v in share.groupby("g", dropna=False)} == {"a": 38, "b": math.ceil(all_rows[all_rows.g == "b"].shape[0] * 15 / 1000), "nan": math.ceil(all_rows.g.isna().sum() * 15 / 1000)}


def test_allocate():
    q = sampling.allocate({"big": 100, "mid": 10, "small": 2}, 30, 3)
    assert sum(q.values()) == 30 and q["small"] == 2 and q["mid"] >= 3 and q["big"] > q["mid"]
    with pytest.raises(ValueError):
        sampling.allocate({"a": 100, "b": 10}, 2, 3)
    # shares 4.5, 2.52 and 1.98: one unit each to the two greatest fractions
    assert sampling.allocate({"a": 50, "b": 28, "c": 22}, 9, 0) == {"a": 4, "b": 3, "c": 2}
    assert sampling.allocate({"b": 10, "a": 10}, 5, 1) == {"a": 3, "b": 2}
    # the floor fills c; 8 go to a and b as 7.2 and 0.8
    assert sampling.allocate({"a": 90, "b": 10, "c": 2}, 14, 2) == {"a": 9, "b": 3, "c": 2}


def test_diverse_take_spreads():
    rows = pd.DataFrame([(f"r{i}", a) for i, a in enumerate("xxxyyz")], columns=["review_id", "aspect_id"])
    got = sampling.diverse_take(rows, 4, set())
    assert sorted(got.aspect_id[:3]) == ["x", "y", "z"] and got.aspect_id.iloc[3] in "xy"
    used = set(rows.review_id[rows.aspect_id == "z"])
    assert list(sampling.diverse_take(rows, 6, used).aspect_id)[-1] == "z"
    same = pd.DataFrame([("r", "a"), ("r", "b"), ("s", "b")], columns=["review_id", "aspect_id"])
    taken = sampling.diverse_take(same, 2, set())
    assert set(taken.review_id) == {"r", "s"}
    assert len(sampling.diverse_take(same, 9, set())) == 3 and len(sampling.diverse_take(same.head(0), 2, set())) == 0


def test_stratified_weights(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("review_id"), F.when(F.col("id") < 900, "x").otherwise("y").alias("s"))
    got = sampling.stratified(df, "s", "review_id", 50, 5).toPandas()
    assert len(got) == 50 and abs(got.sampling_weight.sum() - 1000) < 1e-6
    again = sampling.stratified(df.repartition(5), "s", "review_id", 50, 5).toPandas()
    assert set(got.review_id) == set(again.review_id)


def test_balanced_and_combine(spark):
    df = spark.createDataFrame([(f"r{i}", "n" if i < 3 else "p") for i in range(12)], "review_id string, label string")
    assert {r["label"]: r["count"] for r in sampling.balanced(df, "label", "review_id").groupBy("label").count().collect()} == {"n": 3, "p": 3}
    with pytest.raises(ValueError, match="share"):
        sampling.combine(df.withColumn("sampling_weight", F.lit(1.0)), df, "review_id")


def test_cover_targets():
    m = pd.DataFrame([("r1", "p1", "a"), ("r1", "p1", "b"), ("r2", "p2", "b"), ("r3", "p3", "c"), ("r4", "p4", "a"), ("r5", "p1", "c"), ("r6", "p5", "b")], columns=["review_id", "parent_asin", "aspect_id"])
    got = sampling.cover_targets(m, 4, 1, 1)
    assert got == sampling.cover_targets(m.sample(frac=1, random_state=1), 4, 1, 1)
    assert set(m[m.review_id.isin(got)].aspect_id) == {"a", "b", "c"} and m[m.review_id.isin(got)].drop_duplicates("review_id").parent_asin.is_unique


# ---------------------------------------------------------------- catalog, aspects, comparison


def test_registry_key_folds_unicode(spark):
    paths = [["Ｈａｉｒ  Care", "Straße"], ["hair care", "STRASSE"], ["Hair Care", " "], [], None]
    df = spark.createDataFrame([("b", p, "m", f"p{i}") for i, p in enumerate(paths)], "dataset_category string, category_path array<string>, main_category string, parent_asin string")
    got = {r["path_key"]: r for r in catalog.registry(df).collect()}
    assert set(got) == {"hair care > strasse", "hair care"} and got["hair care > strasse"]["records"] == 2
    assert got["hair care"]["category_path_id"].startswith("amazon-category:") and len(got["hair care"]["category_path_id"]) == 40
    assert {r["depth"]: r["nodes"] for r in catalog.category_nodes(df).collect()} == {1: 1, 2: 1}
    assert catalog.registry(df.limit(0)).count() == 0


def test_registry_labels(spark):
    df = spark.createDataFrame([("Ｈａｉｒ  Care ",), ("Straße",), ("  ",), (None,)], "x string")
    assert [r[0] for r in df.select(catalog.display_label("x")).collect()] == ["Hair Care", "Straße", None, None]
    assert [r[0] for r in df.select(catalog.matching_key("x")).collect()] == ["hair care", "strasse", None, None]


def test_alias_evidence(spark):
    names = {"scent": ["scent", "fragrance", "smell"], "packaging": ["bottle design"]}
    df = spark.createDataFrame([("r1", "Lovely scent and smart Bottle  design."), ("r2", "No matching topic, fragrances here."), ("r3", "The smell is unpleasant."), ("r4", None)], "review_id string, text string")
    got = aspects.alias_evidence(df, names).collect()
    assert [(r["review_id"], r["aspect_id"], len(r["evidence"])) for r in got] == [("r1", "packaging", 1), ("r1", "scent", 1), ("r3", "scent", 1)]
    texts = {r["review_id"]: r["text"] for r in df.collect()}
    assert all(texts[r["review_id"]][e["start"] : e["end"]] == e["text"] for r in got for e in r["evidence"])
    assert sorted((r["review_id"], r["aspect_id"]) for r in aspects.alias_mentions(df, names).collect()) == sorted((r["review_id"], r["aspect_id"]) for r in got)
    with pytest.raises(ValueError, match="belongs"):
        aspects.alias_owner({"a": ["x"], "b": ["X "]})


def test_marts_reconcile(spark, tables):
    from sedgeline.plans import views

    m = views.mentions(spark, tables)
    mart = aspects.product_mart(m, views.reviews(spark, tables), views.products(spark, tables))
    month = aspects.month_mart(m, views.reviews(spark, tables))
    total = m.where("parent_asin is not null").count()
    assert mart.agg(F.sum("mentions")).first()[0] == total
    assert month.agg(F.sum("mentions")).first()[0] <= total
    assert month.groupBy("month").count().select("count").distinct().count() == 1
    with pytest.raises(ValueError, match="no mentions"):
        aspects.statistics(m, ["never_seen"])


def test_pair_scores(spark):
    p = spark.createDataFrame([("r1", "a"), ("r1", "b")], "review_id string, aspect_id string")
    t = spark.createDataFrame([("r1", "a"), ("r2", "a")], "review_id string, aspect_id string")
    assert one(evaluation.pair_scores(p, t, ["review_id", "aspect_id"]), "tp", "fp", "fn", "f1") == [(1, 1, 1, 0.5)]
    w = spark.createDataFrame([("r1", 2.0), ("r2", 1.0)], "review_id string, weight double")
    p2 = spark.createDataFrame([("r1", "a"), ("r2", "b")], "review_id string, aspect_id string")
    got = evaluation.pair_scores(p2, t, ["review_id", "aspect_id"], weight=w).first()
    assert got["tp"] == 2.0 and got["precision"] == got["recall"] == 2 / 3


def test_bootstrap_and_proper_scores(spark):
    df = spark.createDataFrame([("p1", "positive", "positive")] * 5 + [("p2", "positive", "negative")] * 5, "parent_asin string, l string, p string")
    got = {r["metric"]: r for r in evaluation.bootstrap(df, "parent_asin", "l", "p").collect()}
    assert got["accuracy"]["low"] == 0.0 and got["accuracy"]["high"] == 1.0
    s = spark.createDataFrame([("positive", 0.5, 0.1, 0.1)], "l string, a double, b double, c double")
    with pytest.raises(ValueError, match="add up"):
        evaluation.proper_scores(s, "l", {"positive": "a", "neutral": "b", "negative": "c"})


def test_error_clues(spark):
    df = spark.createDataFrame([("Great product!", 1, 8), ("WORST purchase!!", 5, 9), (None, None, None)], "review_text string, rating int, token_count int")
    got = evaluation.error_clues(df).collect()
    assert [(r["positive_text_low_rating"], r["negative_text_high_rating"], r["text_against_rating"]) for r in got] == [(True, False, True), (False, True, True), (False, False, False)]
    assert [r["strong_emotion"] for r in got] == [False, True, False] and [r["very_short"] for r in got] == [True, False, False]
    assert got[2]["no_clear_sentiment"] and not got[2]["delivery"]


def test_brand_and_price(spark):
    df = spark.createDataFrame([("dove men care", "dove", 10.0, 10.0), ("ab", "ab c", 10.0, 40.0), ("x", "x", None, 5.0), ("", "", 1.0, 2.0)], "a string, b string, p double, q double")
    got = df.select(compare.same_brand(F.col("a"), F.col("b")), compare.price_similarity(F.col("p"), F.col("q"))).collect()
    assert [r[0] for r in got] == [True, False, True, False] and [round(r[1], 3) for r in got] == [1.0, 0.0, 0.5, 0.5]


def test_vector_and_lexical_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    allowed = spark.createDataFrame([(2,), (3,)], "vec_id long")
    assert [r["vec_id"] for r in search.vector_topk(v, [1.0, 0.0], 2).collect()] == [1, 2]
    assert [r["vec_id"] for r in search.vector_topk(v, [1.0, 0.0], 5, allowed=allowed).collect()] == [2, 3]
    d = spark.createDataFrame([("a", "broken spray pump"), ("b", "spray bottle broken"), ("c", "nice scent")], "id string, text string")
    assert [r["id"] for r in search.similar_documents(d, "id", "text", "a").collect()] == ["b"]


def test_vectors_topk_of_a_query_set(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTOR_BLOCK", 3)
    own = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(20)] + [(20, [0.0, 0.0, 0.0]), (21, None)]
    v = spark.createDataFrame(own, "vec_id long, embedding array<float>")
    queries = v.where("vec_id % 4 = 0")
    got = {}
    for r in search.vectors_topk(v, queries, 4).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
    assert got == {i: [j for _, j in sorted((round(-cos(e, x), 9), j) for j, x in own[:20])[:4]] for i, e in own[:20] if i % 4 == 0}


def test_cosines_of_a_query_set(spark):
    d = spark.createDataFrame([("a", "broken spray pump"), ("b", "spray bottle broken"), ("c", "nice scent"), ("d", "nice pump")], "id string, text string")
    v = search.tfidf_vectors(search.grams(d, "id", "text"))
    got = {(r["query_id"], r["id"]): r["score"] for r in search.cosines_of(v, F.col("id").isin("a", "c")).collect()}
    want = {(q, r["id"]): r["score"] for q in "ac" for r in search.cosine_to(v, F.col("id") == q).collect()}
    assert set(got) == {("a", "b"), ("a", "d"), ("c", "d")} == set(want) and all(got[x] == pytest.approx(want[x]) for x in got)


def test_retrieve(spark):
    texts = ["The spray pump broke immediately", "The spray nozzle broke after a week", "Broken spray trigger on arrival", "The scent was unpleasant", "broken SPRAY trigger, on arrival!"]
    reviews = spark.createDataFrame([(f"r{i + 1}", f"p{p}", 1, None, h, t) for i, (p, h, t) in enumerate(zip([1, 1, 2, 3, 2], [3, 1, 2, 10, 9], texts))], "review_id string, parent_asin string, rating int, ts timestamp, helpful int, text string")
    seen = spark.createDataFrame([(f"r{i + 1}", a, "negative", p, '[{"text":"spray"}]') for i, (a, p) in enumerate([("pump", 0.9), ("pump", 0.8), ("pump", 0.7), ("scent", 0.95), ("pump", 0.1)])] + [("r1", "other", "positive", 1.5, None)], "review_id string, aspect_id string, sentiment string, probability double, evidence string")
    got = search.retrieve(seen, reviews, "Broken spray", "pump", "negative", ["p1", "p2", "p3"], 3, 1).collect()
    assert [r["parent_asin"] for r in got] == ["p2", "p1"] and all(r["retrieval_score"] > 0 and r["aspect_id"] == "pump" for r in got)
    assert got[0]["evidence_phrases"] == ["spray"] and got[0]["retrieval_method"] == "lexical_tfidf_v1" and got[0]["review_id"] == "r3"
    docs = [[w for w in t.lower().split() if w not in search.STOP] for t in ("broken spray", *texts[:3])]
    docs = [d + [f"{a} {b}" for a, b in zip(d, d[1:])] for d in docs]
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    vec = [{t: math.log(5 / (1 + df[t])) + 1 for t in d} for d in docs]
    cos = [sum(vec[0].get(t, 0) * w for t, w in v.items()) / math.sqrt(sum(w * w for w in v.values()) * sum(w * w for w in vec[0].values())) for v in vec]
    assert got[0]["retrieval_score"] == pytest.approx(0.80 * cos[3] + 0.15 * 0.7 + 0.05 * math.log(3) / math.log(4))
    assert search.retrieve(seen, reviews, "shiny bottle").count() == 0
    dense = spark.createDataFrame([("r4", 0.7), ("r1", 1.4)], "review_id string, dense_score double")
    both = {r["review_id"]: r for r in search.retrieve(seen, reviews, "shiny bottle", dense=dense).collect()}
    assert set(both) == {"r1", "r4"} and both["r4"]["retrieval_method"] == "hybrid_tfidf_lsa_v1"
    assert both["r4"]["retrieval_score"] == pytest.approx(0.25 * 0.7 + 0.15 * 0.95 + 0.05) and (both["r1"]["dense_score"], both["r1"]["aspect_id"]) == (1.0, "other")
    with pytest.raises(ValueError, match="query"):
        search.retrieve(seen, reviews, " ! ")


def test_router_and_citations():
    triggers = {"scent": ["smell"], "hold": ["hold", "strong hold"]}
    assert search.route("Why is the strong hold bad?", triggers, ["bad"], ["good"]) == ("hold", "negative")
    assert search.citations("yes [R1] and [R2] and [R1]", {"R1", "R2"}) == ["R1", "R2"]
    with pytest.raises(ValueError):
        search.citations("[R9]", {"R1"})


def test_segmented_sample(spark):
    df = spark.range(300).select(F.concat(F.lit("r"), "id").alias("review_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 4).cast("string").alias("s"))
    taken = df.where("g = 'a'").limit(10)
    got = sampling.segmented(df, "g", "s", "review_id", {"a": 20, "b": 33}, 3, taken=(taken,)).toPandas()
    assert {k: len(v) for k, v in got.groupby("g")} == {"a": 20, "b": 33}
    assert {k: round(v.sampling_weight.sum(), 6) for k, v in got.groupby("g")} == {"a": 90.0, "b": 200.0}
    assert not set(got.review_id) & {r["review_id"] for r in taken.collect()}
    with pytest.raises(ValueError, match="without total"):
        sampling.segmented(df, "g", "s", "review_id", {"a": 20}, 3)
    with pytest.raises(ValueError, match="without total"):
        sampling.segmented(df.limit(0), "g", "s", "review_id", {"a": 20}, 3)


def test_models_are_compared_one_to_one(spark):
    a = spark.createDataFrame([("r1", "x", "x"), ("r2", "x", "y")], "k string, l string, p string")
    got = {r["outcome"]: r["n"] for r in evaluation.model_comparison(a, a.select("k", F.lit("x").alias("p")), "k", "l", "p").collect()}
    assert got == {"both_right": 1, "only_second_right": 1}
    with pytest.raises(ValueError, match="repeats"):
        evaluation.model_comparison(a, a.unionByName(a), "k", "l", "p")


def test_grounding_folds_typography():
    text = "Well… it `really` smells   nice, doesn’t it"
    for phrase, want in (("well... it", "Well… it"), ("'really' smells nice", "really` smells   nice"), ("DOESN'T it", "doesn’t it"), ("", None), ("smells very", None)):
        got = spans.ground(phrase, text)
        assert (got and text[got[0] : got[1]]) == want
