"""P9. Evaluation texts inside training documents: SimHash windows with multi-index Hamming blocks.

The passage that counts as a leak sets the window: WORDS consecutive words of an
item, for items in LETTER_LANGS LETTERS consecutive characters of its words.
Every window of the items and of the documents gets a 64-bit SimHash. The
items' fingerprints stand in RADIUS + 1 tables, one per block of bits; two fingerprints
within RADIUS bits agree in at least one whole block, so looking up every block
of a document's window finds all windows within the radius. Candidates are
verified: the windows are equal word by word (a run; SimHash distance 0, so
none is missed), or the item laid over the document at that place has a weighted
shingle similarity of at least SIMILAR (shingles of SHINGLE words, weighted by
their characters) although words were changed.

A similarity of 0.8 leaves at most a ninth of an item's shingles out, and a changed place
costs four or more, so what reaches it nearly always holds an unchanged run of a window:
the blocks find it by that window, however far the edited windows' fingerprints
lie. ``tests`` measure the recall on passages with several rates of edits against all places.

The items are the query set: they are held by the tasks in portions of about
PORTION_BYTES of text, and each portion passes over all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm.bags import CACHE, words
from sedgeline.session import width

WORDS, LETTERS, LETTER_LANGS = 12, 24, ("zh", "ja")
RADIUS, SHINGLE, SIMILAR = 3, 5, 0.8
BLOCKS = RADIUS + 1
BLOCK_BITS = 64 // BLOCKS
#: Bytes of the items' texts in one pass, tokens whose fingerprints are formed at once.
PORTION_BYTES, AT_ONCE = 16 << 20, 40_000
CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]")


def simhash(tokens: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` tokens (64-bit hashes): the majority of each bit."""
    if len(tokens) < size:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(tokens.view(np.uint8).reshape(-1, 8), axis=1)
    run = np.zeros((len(tokens) + 1, 64), np.uint16)
    np.cumsum(bits, axis=0, dtype=np.uint16, out=run[1:])  # wraps; differences within a window stay right
    return np.packbits((run[size:] - run[:-size]) * 2 > size, axis=1).view(np.uint64).ravel()


def blocks_of(prints: np.ndarray, k: int) -> np.ndarray:
    return ((prints >> np.uint64(k * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


class Hasher:
    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = xxhash.xxh3_64_intdigest(t)
        return np.fromiter((known[t] for t in tokens), np.uint64, len(tokens))


@dataclass
class Probe:
    """The windows of a portion of items of one kind, in block tables."""

    size: int
    ids: list[int] = field(default_factory=list)
    tokens: list[list[str]] = field(default_factory=list)

    def build(self, hasher: Hasher) -> Probe:
        parts = [hasher(t) for t in self.tokens]
        self.hashes = np.concatenate([*parts, np.empty(0, np.uint64)])
        self.begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        prints = [simhash(p, self.size) for p in parts]
        self.prints = np.concatenate([*prints, np.empty(0, np.uint64)])
        self.item = np.repeat(np.arange(len(parts)), [len(p) for p in prints])
        self.place = np.concatenate([*[np.arange(len(p)) for p in prints], np.empty(0, np.int64)]).astype(np.int64)
        self.orders, self.starts = [], []
        for k in range(BLOCKS):
            b = blocks_of(self.prints, k)
            self.orders.append(np.argsort(b, kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(b, minlength=1 << BLOCK_BITS))]))
        letters = [bool(CJK.search("".join(t[i : i + self.size]))) for t in self.tokens for i in range(len(t) - self.size + 1)] if self.size == LETTERS else [False]
        #: whether a document without a character of these scripts can hold no window
        self.only_cjk = all(letters)
        return self

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (document window, item window) within RADIUS bits."""
        left, right = [], []
        for k in range(BLOCKS):
            b = blocks_of(prints, k)
            s = self.starts[k][b]
            n = self.starts[k][b + 1] - s
            total = int(n.sum())
            w = np.repeat(np.arange(len(prints)), n)
            at = self.orders[k][np.repeat(s - (np.cumsum(n) - n), n) + np.arange(total)]
            ok = np.bitwise_count(prints[w] ^ self.prints[at]) <= RADIUS
            left.append(w[ok])
            right.append(at[ok])
        both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def shingles(self, tokens: list[str]) -> Counter:
        out: Counter = Counter()
        for i in range(max(1, len(tokens) - SHINGLE + 1)):
            s = tuple(tokens[i : i + SHINGLE])
            out[s] += sum(map(len, s))
        return out

    def similarity(self, a: list[str], b: list[str]) -> float:
        x, y = self.shingles(a), self.shingles(b)
        union = (x | y).total()
        return (x & y).total() / union if union else 0.0


def matches(probe: Probe, docs: list[list[str]], hasher: Hasher) -> list[tuple[int, int, int, float]]:
    """(document index, item index, longest run, similarity) of documents that hold a passage of an item."""
    found: dict[tuple[int, int], list] = {}
    step = AT_ONCE
    pieces: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal pieces, held
        if not pieces:
            return
        flat = np.concatenate([p[2] for p in pieces])
        sizes = np.array([len(p[2]) for p in pieces])
        begin = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(pieces)), sizes)
        prints = simhash(flat, probe.size)
        inside = own[: len(prints)] == own[probe.size - 1 :]
        at = np.flatnonzero(inside)
        w, t = probe.near(prints[at])
        w = at[w]
        if len(w):
            steps = np.arange(probe.size)
            same = (flat[w[:, None] + steps] == probe.hashes[(probe.begins[probe.item[t]] + probe.place[t])[:, None] + steps]).all(axis=1)
            for p, x, item, place, equal in zip(own[w], w, probe.item[t], probe.place[t], same):
                doc, offset, _ = pieces[p]
                spot = int(x - begin[p]) + offset
                found.setdefault((doc, int(item)), []).append((spot - int(place), spot, bool(equal)))
        pieces, held = [], 0

    for d, tokens in enumerate(docs):
        if len(tokens) < probe.size:
            continue
        h = hasher(tokens)
        for o in range(0, len(h) - probe.size + 1, step):
            piece = h[o : o + step + probe.size - 1]
            pieces.append((d, o, piece))
            held += len(piece)
            if held >= step:
                flush()
    flush()
    out = []
    for (d, item), hits in found.items():
        longest, run, last = 0, 0, None
        for shift, spot, equal in sorted(hits):
            if equal:
                run = run + 1 if last == (shift, spot - 1) else probe.size
                longest, last = max(longest, run), (shift, spot)
        text = probe.tokens[item]
        best = 0.0
        for shift in {h[0] for h in hits}:
            best = max(best, probe.similarity(text, docs[d][max(0, shift) : max(0, shift + len(text))]))
        if longest or best >= SIMILAR:
            out.append((d, item, longest, best))
    return out


LEAK = "doc_id long, item_id long, longest_run int, similarity double"


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, longest_run, similarity): documents that hold a passage of an item.

    ``longest_run``: consecutive words (characters for items in zh and ja)
    common to both, 0 if shorter than a window; ``similarity``: of the whole item
    to the best place in the document. A row stands for a run of a window or more, or a
    similarity of SIMILAR. Null texts and ids, and items shorter than a window,
    match nothing; repeated documents and items give one row (the greatest values);
    very long texts are taken whole, in overlapping pieces.
    """
    spark = documents.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.trim("item_lang")).alias("lang"), "text").where("item_id is not null and text is not null").distinct()
    held = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    numbered = asked.withColumn("portion", F.pmod(F.xxhash64("item_id"), F.lit(-(-held // PORTION_BYTES))))
    portions = range(-(-held // PORTION_BYTES))
    out = None
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    if portions and rows.rdd.getNumPartitions() < width(spark):
        rows = rows.repartition(width(spark))
    for p in portions:
        own = [(r["item_id"], r["lang"] or "", r["text"]) for r in numbered.where(F.col("portion") == p).collect()]
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            hasher, by_word, by_letter = Hasher(), Probe(WORDS), Probe(LETTERS)
            for i, lang, text in shared.value:
                probe, tokens = (by_letter, list("".join(words(text)))) if lang[:2] in LETTER_LANGS else (by_word, words(text))
                if len(tokens) >= probe.size:
                    probe.ids.append(i)
                    probe.tokens.append(tokens)
            by_word.build(hasher)
            by_letter.build(hasher)
            for pdf in batches:
                for i in range(0, len(pdf), 2000):
                    part = pdf.iloc[i : i + 2000]
                    ids, docs, res = part["doc_id"].tolist(), [words(t) for t in part["text"]], []
                    if by_word.ids:
                        res += [(ids[d], by_word.ids[k], n, s) for d, k, n, s in matches(by_word, docs, hasher)]
                    if by_letter.ids:
                        letters = ["".join(d) for d in docs]
                        letters = [list(x) if not by_letter.only_cjk or CJK.search(x) else [] for x in letters]
                        res += [(ids[d], by_letter.ids[k], n, s) for d, k, n, s in matches(by_letter, letters, hasher)]
                    yield pd.DataFrame(res, columns=["doc_id", "item_id", "longest_run", "similarity"])

        got = rows.mapInPandas(run, LEAK)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], LEAK)
    return out.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.max("similarity").alias("similarity"))


def leaked_passages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents with at least WORDS consecutive words (LETTERS characters in zh and ja) of the item."""
    return leaks(documents, items).where("longest_run > 0").select("doc_id", "item_id")
