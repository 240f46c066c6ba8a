"""P2. Near-duplicates with small edits: segment-popcount embedding and grid range-join.

The fingerprint of a text has one bit per element of its bag of words (word
and occurrence, so order does not count). The bits fall into segments by their
hash; a text is embedded as the number of set bits of each segment. For two
texts the Manhattan distance of these counts is at most the Hamming distance of the
fingerprints, that is |A| + |B| - 2|A and B|, and a similarity (intersection
over union) of t allows a distance of at most (1-t)/(1+t) * (|A|+|B|): pairs whose
counts lie further apart cannot be alike, and none that are alike is lost.

The grid's first axis is the total popcount, with cells as wide as the range that
similarity t allows, so that the range-join needs only a cell and the next; texts
of a cell are packed in blocks that meet each other. Within two blocks the cells are fine
segments of 24 bits, from rare to frequent: alike texts have at most |A| - o
elements that the other lacks (o: the words they must share at these sizes), so
they lie together in LEAST of the first |A| - o + LEAST fine segments that each of
them occupies. Pairs that do are tested by the Manhattan distance over SEGMENTS
segments, and the survivors exactly. Equal bags are joined beforehand, so a
group of copies of any size is one text here.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.functions.text import strip
from sedgeline.llm.bags import LEAST, Block, bag_rows, bags_of, length_pairs, meet, near_pairs, packed, place_counts, verified
from sedgeline.llm.components import hash_to_min
from sedgeline.session import cut, width

#: Ids of a class of equal texts that meet those of another part at once.
PART = 512


def first_cells(n: np.ndarray, other: float, similarity: float, least: int) -> np.ndarray:
    """How many of its rarest elements a text of size n shows to texts of at least ``other`` words; none where no text is that large."""
    need = np.maximum(np.ceil(similarity / (1 + similarity) * (n + other) - 1e-9), np.ceil(similarity * n - 1e-9))
    return np.where(need > n, 0, n - need + least).astype(np.int64)


def block_pairs(x: pd.Series, y: pd.Series, similarity: float) -> pd.DataFrame:
    a, b = Block.of(x), Block.of(y)
    lo_a, lo_b = int(a.n.min()), int(b.n.min())
    least = max(1, min(LEAST, math.ceil(similarity * max(lo_a, lo_b) - 1e-9)))
    return near_pairs(a, b, x["a"] == x["b"], first_cells(a.n, lo_b, similarity, least), first_cells(b.n, lo_a, similarity, least), least, similarity)


def links(bags: DataFrame, similarity: float) -> DataFrame:
    """(x, y, shared, nx, ny): all pairs of different bags with intersection over union of at least ``similarity``."""
    blocks = packed(bags, place_counts(bags), lambda n: first_cells(n, 0.0, similarity, LEAST))
    pairs = length_pairs(blocks, blocks, similarity).where(F.col("a") <= F.col("b"))
    found = meet(blocks, blocks, pairs, lambda a, b: block_pairs(a, b, similarity), "x binary, y binary")
    return verified(cut(found), bags, similarity)


def review_texts(reviews: DataFrame) -> DataFrame:
    """(id, text): title and text together; null parts are empty, rows without a review_id are left out."""
    return reviews.select(F.nullif(strip("review_id"), F.lit("")).alias("id"), F.concat_ws(" ", F.coalesce("review_title", F.lit("")), F.coalesce("review_text", F.lit(""))).alias("text"))


def parts(texts: DataFrame, similarity: float, least_words: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, bag; links between bags)."""
    rows = cut(bag_rows(texts, least_words))
    return cut(rows.select("id", "bag").distinct()), links(cut(bags_of(rows)), similarity)


def all_pairs(texts: DataFrame, similarity: float = 0.7, least_words: int = 20) -> DataFrame:
    """(id_1, id_2): all pairs of different ids, smaller first, whose texts are alike, classes of equal bags of any size included.

    The members of a class are dealt into parts of about PART ids by their hash; a link between
    two classes, or of a class with itself, is a row for each pair of parts, so that no
    task writes more than about PART x PART pairs at once. Texts with fewer than ``least_words``
    words, null texts and ids are left out; an id with several texts is alike to another by any of them.
    """
    members, between = parts(texts, similarity, least_words)
    sizes = cut(members.groupBy("bag").agg(F.count("*").alias("size")).withColumn("cuts", F.ceil(F.col("size") / PART).cast("int")))
    held = members.join(sizes, "bag").withColumn("part", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).groupBy("bag", "part").agg(F.collect_list("id").alias("ids"))
    own = sizes.where("size > 1").select(F.col("bag").alias("x"), F.col("bag").alias("y"), F.col("cuts").alias("cx"), F.col("cuts").alias("cy"))
    other = between.select("x", "y").join(sizes.select(F.col("bag").alias("x"), F.col("cuts").alias("cx")), "x").join(sizes.select(F.col("bag").alias("y"), F.col("cuts").alias("cy")), "y").select("x", "y", "cx", "cy")
    units = own.unionByName(other).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cy") - 1))).where("x <> y or i <= j").select("x", "y", "i", "j")
    held = cut(held)
    met = units.join(held.select(F.col("bag").alias("x"), F.col("part").alias("i"), F.col("ids").alias("ps")), ["x", "i"]).join(held.select(F.col("bag").alias("y"), F.col("part").alias("j"), F.col("ids").alias("qs")), ["y", "j"])
    spread = met.repartition(4 * width(texts.sparkSession), "x", "y", "i", "j")
    once = spread.withColumn("p", F.explode("ps")).select("x", "y", "i", "j", "p", F.explode("qs").alias("q")).where("p <> q and (x <> y or i <> j or p < q)")
    return once.select(F.least("p", "q").alias("id_1"), F.greatest("p", "q").alias("id_2")).distinct()


def groups(texts: DataFrame, similarity: float = 0.7, least_words: int = 20) -> DataFrame:
    """(id, class_id, bag, copies, links): every text with enough words once, with what it belongs to.

    ``class_id`` names the connected group of alike texts, ``bag`` the class of
    texts with the same words (reordered or equal ones), of which there are ``copies``.
    ``links`` counts the different texts alike to this one. The pairs of ``all_pairs``
    are those of linked bags and those within a bag. An id with several texts has a row for each.
    """
    members, between = parts(texts, similarity, least_words)
    between = cut(between.select("x", "y"))
    names = hash_to_min(between.select(F.xxhash64("x").alias("a"), F.xxhash64("y").alias("b")))
    degree = between.select(F.explode(F.array("x", "y")).alias("bag")).groupBy("bag").agg(F.count("*").alias("links"))
    sizes = members.groupBy("bag").agg(F.count("*").alias("copies")).join(degree, "bag", "left").withColumn("node", F.xxhash64("bag")).join(names, "node", "left")
    own = sizes.select("bag", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.hex(F.coalesce("component", "node")).alias("class_id"))
    return members.join(own, "bag").select("id", "class_id", F.hex("bag").alias("bag"), "copies", "links")
