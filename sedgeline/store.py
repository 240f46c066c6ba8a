"""A facade over the tables: what an application asks for, as DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.operators import aspects, compare, search
from sedgeline.plans import views


class ReviewStore:
    """Reads the tables of a folder; every method is one declarative plan over them.

    ``mart`` and ``rankings`` are built once per store and may be written with ``sources.sinks``
    and read again by an application that asks often.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @cached_property
    def reviews(self) -> DataFrame:
        return views.reviews(self.spark, self.folder)

    @cached_property
    def products(self) -> DataFrame:
        return views.products(self.spark, self.folder)

    @cached_property
    def mentions(self) -> DataFrame:
        return views.mentions(self.spark, self.folder)

    @cached_property
    def mart(self) -> DataFrame:
        return aspects.product_mart(self.mentions, self.reviews, self.products)

    @cached_property
    def rankings(self) -> DataFrame:
        return aspects.rankings(self.mart)

    def search_products(self, text: str, n: int = 20) -> DataFrame:
        return compare.product_search(self.products, text, n)

    def competitors(self, product: str, k: int = 4, least_reviews: int = 1) -> DataFrame:
        """Direct competitors; where too few have enough reviews the floor falls to one."""
        found = compare.competitors(self.products, product, None, k, least_reviews).where("selected")
        return found if least_reviews <= 1 or found.limit(k).count() == k else compare.competitors(self.products, product, None, k, 1).where("selected")

    def workspace(self, product: str, others: list[str] | None = None, k: int = 4) -> Workspace:
        if others is None:
            others = [r["parent_asin"] for r in self.competitors(product, k).collect()]
        return Workspace(self, product, others)

    def evidence(self, aspect: str, negative: bool = True, n: int = 10, per_product: int = 2, products: list[str] | None = None) -> DataFrame:
        own = self.mentions if products is None else self.mentions.where(F.col("parent_asin").isin(products))
        return search.evidence(own, self.reviews, aspect, negative, per_product, n)

    def similar_reviews(self, review_id: str, n: int = 10) -> DataFrame:
        return search.similar_documents(self.reviews, "review_id", "text", review_id, n)

    def context(self, aspect: str, negative: bool = True, budget: int = 12_000, most: int = 8) -> DataFrame:
        """Numbered review texts within a character budget, for a cited answer."""
        found = self.evidence(aspect, negative, most)
        texts = found.join(self.reviews.select("review_id", "text"), "review_id")
        return search.context_budget(texts, [F.col("helpful").desc(), F.col("review_id")], "text", budget, most)


class Workspace:
    """One product set against a few others."""

    def __init__(self, store: ReviewStore, product: str, others: list[str]) -> None:
        if product in others:
            raise ValueError("a product cannot be its own competitor")
        self.store, self.product, self.others = store, product, others

    @cached_property
    def comparison(self) -> DataFrame:
        return compare.comparison(self.store.mart, self.store.reviews, self.product, self.others)

    def weaknesses(self, gap: float = 5.0) -> DataFrame:
        return compare.weaknesses(self.comparison, gap)

    def strengths(self, gap: float = 5.0, least_share: float = 0.55) -> DataFrame:
        return compare.strengths(self.comparison, gap, least_share)

    def overview(self) -> DataFrame:
        return compare.overview(self.store.reviews.where(F.col("parent_asin").isin([self.product, *self.others])))

    def trend(self) -> DataFrame:
        return compare.aspect_trend(self.store.mentions, self.product)

    def repurchase(self) -> DataFrame:
        return compare.repurchase(self.store.reviews.where(F.col("parent_asin").isin([self.product, *self.others])))
