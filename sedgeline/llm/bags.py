"""Texts as bags of words: every word counted as often as it occurs.

A bag is kept as its words in order, in one text (``bow``). Bags that are equal
are kept once (``bag`` is their md5), with the texts that have them beside. An
element of a bag is (word, k), the k-th occurrence of the word, as a 64-bit
hash: two bags have in common as many words, occurrences counted, as they
share elements. For the search a bag is packed as its rarest elements, from rare to
frequent, and its popcounts by segment; bags that are alike share at least LEAST
of the elements that ``meetings`` looks at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.session import cut, maybe_broadcast, width

TAG, WORD = re.compile(r"<[^>]*>"), re.compile(r"[^\W_]+")
#: Step between the hashes of a word's occurrences (odd, so that they never meet within a text).
STEP = 0x9E3779B97F4A7C15
#: Words that a task remembers the hash of.
CACHE = 300_000
#: Bytes of a block, and rows that are added to it at once.
BLOCK_BYTES, STEP_ROWS = 16 << 20, 512
#: Texts of a block, and texts whose meetings are counted at once.
BLOCK, AT_ONCE = 16_384, 8
#: Bits of a text's place in its block.
DOC_BITS = 24
#: Rare elements that two texts must share before their popcounts are compared.
LEAST = 6
#: Segments of the popcounts.
SEGMENTS = 64
#: Places of the table of element counts (of one size whatever the data); bits of an element in a packed bag.
BITS = 17
BUCKETS, TERM_BITS = 1 << BITS, 24


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, tags taken as blanks."""
    return WORD.findall(TAG.sub(" ", text).lower()) if text else []


def elements(bows: list[list[str]], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The elements of many bags (words in order) one after another, and how many each has."""
    if len(known) > CACHE:
        known.clear()
    flat = [w for b in bows for w in b]
    for w in set(flat).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array([known[w] for w in flat], np.uint64)
    lens = np.array([len(b) for b in bows], np.int64)
    fresh = np.ones(len(h), bool)  # where another word or bag begins
    fresh[1:] = h[1:] != h[:-1]
    fresh[(np.cumsum(lens) - lens)[lens > 0]] = True
    at = np.arange(len(h))
    return h + (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64) * np.uint64(STEP), lens


def bag_rows(texts: DataFrame, least_words: int) -> DataFrame:
    """(id, bag, n, bow) of texts (id, text) with at least ``least_words`` words; repeats stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, keys, sizes, bows = [], [], [], []
            for i, text in zip(pdf["id"], pdf["text"]):
                tokens = words(text)
                if len(tokens) >= least_words:
                    bow = " ".join(sorted(tokens))
                    ids.append(i)
                    keys.append(hashlib.md5(bow.encode()).digest())
                    sizes.append(len(tokens))
                    bows.append(bow)
            if ids:  # an empty column has no type that Arrow takes for text
                yield pd.DataFrame({"id": ids, "bag": keys, "n": sizes, "bow": bows})

    rows = texts.select("id", "text").where("id is not null and text is not null")
    return rows.mapInPandas(run, "id string, bag binary, n int, bow string")


def bags_of(rows: DataFrame) -> DataFrame:
    """(bag, n, bow): every bag once."""
    return rows.groupBy("bag").agg(F.first("n").alias("n"), F.first("bow").alias("bow"))


def places(els: np.ndarray) -> np.ndarray:
    return (els >> np.uint64(64 - BITS)).astype(np.int64)


def place_counts(bags: DataFrame) -> np.ndarray:
    """How many elements of all bags fall in each of BUCKETS places; elements that share one share its count, which changes their order and no result."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, known = np.zeros(BUCKETS, np.int64), {}
        for pdf in batches:
            for i in range(0, len(pdf), STEP_ROWS):
                e, _ = elements([b.split(" ") for b in pdf["bow"].iloc[i : i + STEP_ROWS]], known)
                total += np.bincount(places(e), minlength=BUCKETS)
        k = np.flatnonzero(total)
        yield pd.DataFrame({"place": k, "n": total[k]})

    rows = bags.select("bow").mapInPandas(partial, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(BUCKETS, np.int64)
    count[rows["place"]] = rows["n"]
    return count


def popcounts(e: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Popcounts by segment, a row a bag; more than 255 count as 255, which lowers a distance and never raises it."""
    cell = np.repeat(np.arange(len(lens)) * SEGMENTS, lens) + (e >> np.uint64(64 - SEGMENTS.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=len(lens) * SEGMENTS), 255).astype(np.uint8).reshape(len(lens), SEGMENTS)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distances of the rows of ``a`` and ``b``, one by one."""
    return (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int32)


def rarest(e: np.ndarray, lens: np.ndarray, count: np.ndarray, most: np.ndarray) -> list[np.ndarray]:
    """The ``most`` rarest elements of each bag from rare to frequent, of TERM_BITS bits (two that look equal then only meet in vain)."""
    doc = np.repeat(np.arange(len(lens)), lens)
    terms = (e[np.lexsort((e, count[places(e)], doc))] >> np.uint64(64 - TERM_BITS)).astype("<u4")
    begin = np.cumsum(lens) - lens
    return [terms[b : b + min(k, n)] for b, n, k in zip(begin, lens, most)]


def packed(bags: DataFrame, count: np.ndarray, longest: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Blocks of bags: sizes, popcounts and the first ``longest(size)`` elements of each."""
    shared = bags.sparkSession.sparkContext.broadcast(count.astype(np.int64))

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            for i in range(0, len(pdf), STEP_ROWS):
                own = pdf.iloc[i : i + STEP_ROWS]
                e, lens = elements([b.split(" ") for b in own["bow"]], known)
                terms = rarest(e, lens, shared.value, longest(own["n"].to_numpy(np.int64)))
                yield own[["bag", "n"]].assign(segs=[x.tobytes() for x in popcounts(e, lens)], terms=[x.view(np.uint8).reshape(-1, 4)[:, :3].tobytes() for x in terms])

    def pack(pdf: pd.DataFrame) -> dict:
        return {"lo": int(pdf["n"].min()), "hi": int(pdf["n"].max()), "ids": b"".join(pdf["bag"]), "sizes": pdf["n"].to_numpy(np.int32).tobytes(), "lens": (pdf["terms"].map(len) // 3).to_numpy(np.int32).tobytes(), "segs": b"".join(pdf["segs"]), "terms": b"".join(pdf["terms"])}

    rows = bags.select("bag", "n", "bow").mapInPandas(embed, "bag binary, n int, segs binary, terms binary")
    return wrap(rows, ["n", "bag"], BLOCK, pack, "lo int, hi int, ids binary, sizes binary, lens binary, segs binary, terms binary", bags.count(), "terms")


@dataclass
class Block:
    """A block in arrays; ``lens`` elements of each text follow one another in ``terms``."""

    n: np.ndarray
    segs: np.ndarray
    lens: np.ndarray
    terms: np.ndarray
    ids: bytes

    @classmethod
    def of(cls, r: pd.Series) -> Block:
        n = np.frombuffer(r["sizes"], np.int32).astype(np.int64)
        three = np.frombuffer(r["terms"], np.uint8).reshape(-1, 3)
        terms = np.zeros((len(three), 4), np.uint8)
        terms[:, :3] = three
        return cls(n, np.frombuffer(r["segs"], np.uint8).reshape(len(n), SEGMENTS), np.frombuffer(r["lens"], np.int32).astype(np.int64), terms.view("<u4").ravel(), r["ids"])

    def first(self, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ``most`` elements of every text, and how many these are."""
        at = np.arange(len(self.terms)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        return self.terms[at < np.repeat(most, self.lens)], np.minimum(most, self.lens)

    def names(self, at: np.ndarray) -> list[bytes]:
        return [self.ids[16 * i : 16 * i + 16] for i in at]


def meetings(a: Block, b: Block, of_a: np.ndarray, of_b: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), begin[i] <= j < end[i], whose first ``of_a[i]`` and ``of_b[j]`` elements have ``least`` in common, by inverted lists of b."""
    terms, lens = b.first(of_b)
    place = np.sort(terms.astype(np.int64) << DOC_BITS | np.repeat(np.arange(len(b.n)), lens))
    docs = place & ((1 << DOC_BITS) - 1)
    ask, asked = a.first(of_a)
    ask = ask.astype(np.int64) << DOC_BITS
    start = np.searchsorted(place, ask | np.repeat(begin, asked), "left")
    size = np.maximum(np.searchsorted(place, ask + np.repeat(end, asked), "left") - start, 0)
    edge, m = np.concatenate([[0], np.cumsum(asked)]), len(b.n)
    for q in range(0, len(a.n), AT_ONCE):
        r = min(q + AT_ONCE, len(a.n))
        s, z = start[edge[q] : edge[r]], size[edge[q] : edge[r]]
        total = int(z.sum())
        if total >= least:
            own = np.repeat(np.arange(r - q) * m, asked[q:r])
            at = np.repeat(s - (np.cumsum(z) - z), z) + np.arange(total)
            hit = np.flatnonzero(np.bincount(np.repeat(own, z) + docs[at], minlength=(r - q) * m) >= least)
            if len(hit):
                yield q + hit // m, hit % m


def near_pairs(a: Block, b: Block, same: bool, of_a: np.ndarray, of_b: np.ndarray, least: int, similarity: float) -> pd.DataFrame:
    """(x, y): bags that meet and whose sizes and popcounts do not rule out the similarity."""
    ratio, xs, ys = (1 - similarity) / (1 + similarity), [], []
    begin, end = np.searchsorted(b.n, np.ceil(a.n * similarity - 1e-9), "left"), np.searchsorted(b.n, np.floor(a.n / similarity + 1e-9), "right")
    if same:
        begin = np.maximum(begin, np.arange(len(a.n)) + 1)
    for i, j in meetings(a, b, of_a, of_b, begin, end, least):
        keep = apart(a.segs[i], b.segs[j]) <= ratio * (a.n[i] + b.n[j]) + 1e-9
        xs.append(i[keep])
        ys.append(j[keep])
    if not xs:
        return pd.DataFrame({"x": [], "y": []})
    return pd.DataFrame({"x": a.names(np.concatenate(xs)), "y": b.names(np.concatenate(ys))})


def wrap(rows: DataFrame, order: list[str], size: int, pack: Callable[[pd.DataFrame], dict], schema: str, count: int, heavy: str) -> DataFrame:
    """Rows in blocks of at most about ``size`` rows and BLOCK_BYTES of the column ``heavy``, ranged by ``order``: (block, ...) as ``pack`` makes of each."""
    parts = max(1, math.ceil(count / size))
    ranged = (rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held, rows, weight = TaskContext.get().partitionId(), 0, [], 0, 0
        for pdf in batches:
            for i in range(0, len(pdf), STEP_ROWS):
                own = pdf.iloc[i : i + STEP_ROWS]
                held.append(own)
                rows += len(own)
                weight += int(own[heavy].map(len).sum())
                if rows >= size or weight >= BLOCK_BYTES:
                    yield block(part, number, held)
                    number, held, rows, weight = number + 1, [], 0, 0
        if held:
            yield block(part, number, held)

    def block(part: int, number: int, held: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.DataFrame([{"block": (part << 24) + number, **pack(pd.concat(held, ignore_index=True))}])

    return cut(ranged.mapInPandas(run, f"block long, {schema}"))


def length_pairs(left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of blocks with texts whose sizes differ by no more than ``similarity`` allows.

    A range-join on a grid: cells of the logarithm of the size, as wide as the
    range; a block of ``left`` meets the blocks of ``right`` in its cells and
    those beside them.
    """
    step = math.log(1 / similarity)
    cell = lambda c: F.floor(F.log(F.col(c).cast("double")) / step + 1e-9).cast("int")
    near = left.select(F.col("block").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence(cell("lo") - 1, cell("hi") + 1)).alias("cell"))
    far = right.select(F.col("block").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    return near.join(far, "cell").where((F.col("blo") * similarity <= F.col("ahi") + 1e-9) & (F.col("bhi") >= F.col("alo") * similarity - 1e-9)).select("a", "b").distinct()


def meet(left: DataFrame, right: DataFrame, pairs: DataFrame, work: Callable[[pd.Series, pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on every pair of blocks (a of ``left``, b of ``right``) of ``pairs``; each pair is a unit of its own."""
    pairs = cut(pairs)
    n = pairs.count()
    parts = min(max(1, n), 4 * width(pairs.sparkSession) + n // 4)
    one = left.join(pairs.select(F.col("a").alias("block"), "a", "b"), "block").withColumn("side", F.lit(0))
    two = right.join(pairs.select(F.col("b").alias("block"), "a", "b"), "block").withColumn("side", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side")
        return work(pdf.iloc[0], pdf.iloc[1])

    return one.unionByName(two, allowMissingColumns=True).repartition(parts, "a", "b").groupBy("a", "b").applyInPandas(run, schema)


def common(a: str, b: str) -> int:
    """Words that two bags share, occurrences counted."""
    return (Counter(a.split(" ")) & Counter(b.split(" "))).total()


def verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """(x, y, shared, nx, ny): the pairs (x, y) of bags whose intersection over union reaches ``similarity``, exactly."""
    ends = pairs.select(F.explode(F.array("x", "y")).alias("bag")).distinct()
    used = bags.join(maybe_broadcast(cut(ends), 32), "bag", "left_semi")
    a = used.select(F.col("bag").alias("x"), F.col("n").alias("nx"), F.col("bow").alias("ex"))
    b = used.select(F.col("bag").alias("y"), F.col("n").alias("ny"), F.col("bow").alias("ey"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shared = np.fromiter((common(p, q) for p, q in zip(pdf["ex"], pdf["ey"])), np.int64, len(pdf))
            pdf["shared"] = shared
            keep = shared >= similarity * (pdf["nx"] + pdf["ny"] - shared) - 1e-9
            yield pdf.loc[keep, ["x", "y", "shared", "nx", "ny"]]

    return pairs.join(a, "x").join(b, "y").select("x", "y", "nx", "ny", "ex", "ey").mapInPandas(run, "x binary, y binary, shared long, nx int, ny int")
