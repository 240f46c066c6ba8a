"""The facade and the structural checks."""

import pytest
from pyspark.sql import functions as F

from sedgeline.operators import checks
from sedgeline.store import ReviewStore


def test_store(spark, tables):
    s = ReviewStore(spark, tables)
    top = [r["parent_asin"] for r in s.reviews.groupBy("parent_asin").count().orderBy(F.col("count").desc(), "parent_asin").limit(3).collect()]
    w = s.workspace(top[0], top[1:])
    compared = w.comparison.toPandas()
    assert (compared.own_mentions >= 0).all() and compared.aspect_id.is_unique
    assert {r["parent_asin"] for r in w.overview().collect()} == set(top)
    assert w.trend().count() > 0 and w.repurchase().count() == 3
    assert w.weaknesses(0.0).count() + w.strengths(0.0, 0.0).count() >= 0
    found = s.evidence("scent", False, 5).collect()
    assert len(found) <= 5 and len({r["review_id"] for r in found}) == len(found)
    assert s.context("scent", False, 400).agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0] <= 400
    assert s.competitors(top[0]).where(F.col("parent_asin") == top[0]).count() == 0
    assert s.search_products("hair").count() > 0
    with pytest.raises(ValueError, match="own competitor"):
        s.workspace(top[0], top)


def test_product_record(spark):
    raw = spark.createDataFrame([("P1 ", "Oil", None, "4.5", "10", "12.5", ["Hair ", ""], None), ("P2", " ", "S", "9", "1.5", "from 10", None, ["a"])], "parent_asin string, title string, store string, average_rating string, rating_number string, price string, categories array<string>, features array<string>")
    a, b = checks.product_record(raw).collect()
    assert (a["parent_asin"], a["price_at_collection"], a["rating_number"], a["category_path"], a["metadata_quality_flags"]) == ("P1", 12.5, 10, ["Hair"], [])
    assert b["metadata_quality_flags"] == ["missing_title", "invalid_price", "invalid_average_rating", "invalid_rating_number", "missing_category"]


def test_structure(spark):
    df = spark.createDataFrame([("a", "x", "v1"), ("a", None, "v1"), ("b", "y", "v1")], "k string, s string, version string")
    assert checks.duplicates(df, ["k"]).first()["n"] == 2
    assert [r["k"] for r in checks.depends(df, "k", ["s"]).collect()] == ["a"]
    assert checks.one_version(df, ["version"]) == {"version": "v1"}
    with pytest.raises(ValueError, match="mixed"):
        checks.one_version(df, ["k"])
    assert {r["s"]: r["n"] for r in checks.frequencies(df, "s").collect()} == {"x": 1, "y": 1, None: 1}
    assert checks.size_profile(df, "k", "version").where("k = 'a'").first()["characters"] == 4


def test_manual_review(spark):
    df = spark.createDataFrame([(f"r{i}", "positive", "negative" if i % 2 else "positive", ["positive", "", None][i % 3]) for i in range(12)], "review_id string, sentiment_label string, predicted_label string, manual_label string")
    q = checks.review_queue(df, F.when(F.col("sentiment_label") == F.col("predicted_label"), "right").otherwise("wrong"), "review_id", 4)
    assert q.count() == 8
    s = checks.manual_summary(df.withColumn("review_group", F.lit("all"))).first()
    assert (s["rows"], s["reviewed"], s["agrees_with_label"], s["agrees_with_prediction"]) == (12, 4, 4, 2)
