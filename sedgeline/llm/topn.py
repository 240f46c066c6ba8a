"""P4. The first N items of every group by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.functions.text import id_lower, id_upper, strip
from sedgeline.session import cut

#: Rows that a task holds before it hands its survivors on; the bound stays valid for any part of a partition.
HELD = 200_000


def top_n(rows: DataFrame, groups: list[str], score: str, ties: list[tuple[str, bool]], n: int) -> DataFrame:
    """The ``n`` first rows of every group by ``score`` descending, then ``ties`` (column, ascending).

    Each task keeps, over its part of the rows, the n best of every group; the
    score of the n-th of them is a lower bound of the group's n-th best. The
    greatest bound of each group is joined to the survivors and drops those
    below it; what is left is ranked. A group of any size reaches the ranking
    with at most n rows per task. Scores must be neither null nor NaN; ties that
    reach through all columns are settled arbitrarily (make the last one unique).
    """
    by, up = [score, *[c for c, _ in ties]], [False, *[a for _, a in ties]]
    columns = rows.columns

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by, ascending=up, kind="stable")
        pdf["__rank"] = pdf.groupby(groups, sort=False, dropna=False).cumcount()
        return pdf[pdf["__rank"] < n]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) > HELD:
                held = [best(pd.concat(held))[columns]]
                if len(held[0]) > HELD // 2:  # many groups: hand on, start anew
                    yield best(held[0])
                    held = []
        if held:
            yield best(pd.concat(held))

    schema = T.StructType([*rows.schema.fields, T.StructField("__rank", T.LongType())])
    survivors = cut(rows.mapInPandas(local, schema))  # read twice: for the bounds and for the rows
    bounds = survivors.where(F.col("__rank") == n - 1).groupBy(*groups).agg(F.max(score).alias("__bound"))
    right = bounds.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], "__bound")
    on = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    kept = survivors.join(right, on, "left").where(F.col("__bound").isNull() | (F.col(score) >= F.col("__bound"))).select(*columns)
    order = [F.col(score).desc(), *[F.col(c).asc() if a else F.col(c).desc() for c, a in ties]]
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= n)


def latest_mentions(mentions: DataFrame) -> DataFrame:
    """(parent_asin, aspect_id, review_id, score, votes): the latest scoring of every review and aspect.

    Ids compare case and blanks aside. A null scored_at is older than any
    other; equal ones are copies, of which one stays. Afterwards rows drop out
    whose score is null, NaN or outside 0..1, or whose product is null; a null
    helpful_vote is 0. Null and empty ids name nobody.
    """
    rows = mentions.select(id_upper("review_id").alias("r"), id_lower("aspect_id").alias("aspect_id"), F.struct("scored_at", F.col("aspect_sentiment_score").alias("score"), "helpful_vote", id_upper("parent_asin").alias("parent_asin"), strip("review_id").alias("review_id")).alias("x")).where("r is not null and aspect_id is not null")
    last = rows.groupBy("r", "aspect_id").agg(F.max("x").alias("x"))
    out = last.select("x.parent_asin", "aspect_id", "x.review_id", F.col("x.score").cast("double").alias("score"), F.coalesce(F.col("x.helpful_vote").cast("long"), F.lit(0)).alias("votes"))
    return out.where("parent_asin is not null and score is not null and not isnan(score) and score between 0 and 1")


def top_mentions(mentions: DataFrame, n: int = 3) -> DataFrame:
    """(parent_asin, aspect_id, review_id, rank): the first n mentions of every product and aspect."""
    return top_n(latest_mentions(mentions), ["parent_asin", "aspect_id"], "score", [("votes", False), ("review_id", True)], n).select("parent_asin", "aspect_id", "review_id", "rank")
