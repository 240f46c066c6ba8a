"""Properties of driver-side steps on random input, and of plans."""

import pytest

pytest.importorskip("hypothesis")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sedgeline.functions import spans  # noqa: E402
from sedgeline.operators.sampling import allocate  # noqa: E402
from sedgeline.plans import queries, views  # noqa: E402
from sedgeline.session import table  # noqa: E402


@given(st.dictionaries(st.text(max_size=3), st.integers(1, 500), min_size=1, max_size=12), st.integers(0, 40), st.data())
@settings(max_examples=200, deadline=None)
def test_allocate_adds_up(sizes, floor, data):
    least = sum(min(n, floor) for n in sizes.values())
    total = data.draw(st.integers(least, sum(sizes.values())))
    q = allocate(sizes, total, floor)
    assert sum(q.values()) == total and all(min(n, floor) <= q[k] <= n for k, n in sizes.items())


@given(st.text(alphabet="ab.!? \n", max_size=80))
@settings(max_examples=200, deadline=None)
def test_pieces_are_ordered_and_trimmed(text):
    own = spans.pieces(text)
    assert all(a < b and text[a] not in " \n" and text[b - 1] not in " \n" for a, b in own)
    assert all(x[1] <= y[0] for x, y in zip(own, own[1:]))


@given(st.lists(st.sampled_from(["nice", "soft", "hair", "oil", "smells", "like", "roses"]), min_size=4, max_size=12))
@settings(max_examples=100, deadline=None)
def test_grounding_finds_what_stands_there(words):
    text = "Before. " + "  ".join(words) + " after"
    a, b = spans.ground(" ".join(words).upper(), text)
    assert text[a:b].split() == words


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_needed(spark, tables):
    p = plan(queries.p5_found(spark, tables))
    assert "review_text" not in p and "product_title" not in p
    p = plan(queries.rating_distribution(spark, tables))
    exchange = next(line for line in p.splitlines() if "Exchange hashpartitioning(user_id" in line)
    assert "review_text" not in exchange  # only its digest crosses
    pushed = plan(table(spark, tables, "reviews").where(F.col("rating") == 5).select("review_id"))
    assert "PushedFilters: [IsNotNull(rating), EqualTo(rating,5.0)]" in pushed and "review_text" not in pushed


def test_hot_product_does_not_reach_one_task_whole(spark, tables):
    """Counts by product leave each task as one partial row per key."""
    p = plan(queries.review_coverage(spark, tables))
    assert "partial_count" in p
    p = plan(views.reviews(spark, tables).groupBy("parent_asin").agg(F.count("*")))
    assert p.count("partial_count") == 1
