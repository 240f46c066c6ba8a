"""P8. Encoding with a public byte-level BPE by a pair occurrence index.

A text is cut into pieces by the tokenizer's pattern; the pieces new to a task
are merged together. Their bytes stand in one array of symbols, linked to
their neighbours within a piece; an index maps each rank (a mergeable pair) to
all its positions. Active ranks are taken in ascending order from a heap; all
positions of the rank are merged from left to right, and the pairs that a merge
makes with its neighbours are entered under their ranks. Every piece thus sees
its lowest-ranked pair first, as the piece-by-piece definition asks, while a pair that
occurs in thousands of pieces is looked up once.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.session import width

#: The public split pattern of this tokenizer family (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces that a task remembers, and symbols that are merged at once.
REMEMBERED, AT_ONCE = 150_000, 2_000_000


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by its rule: printable
    Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class PairIndex:
    """Encoder of pieces; ``vocabulary`` is the text of a byte-level BPE file with ``vocab`` and ``merges``."""

    def __init__(self, vocabulary: str) -> None:
        model = json.loads(vocabulary)["model"]
        ids, names = model["vocab"], byte_names()
        self.byte = [0] * 256
        for char, b in names.items():
            self.byte[b] = ids[char]
        self.rank: dict[tuple[int, int], int] = {}
        self.pair: list[tuple[int, int]] = []
        self.made: list[int] = []
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[ids[a], ids[b]] = r
            self.pair.append((ids[a], ids[b]))
            self.made.append(ids[a + b])
        self.known: dict[str, list[int]] = {}
        self.pattern = regex.compile(PATTERN)

    def merge(self, pieces: list[str]) -> list[list[int]]:
        symbols: list[int] = []
        ends: list[int] = []
        for p in pieces:
            symbols += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
            ends.append(len(symbols))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        start = 0
        for e in ends:
            if e > start:
                after[e - 1], before[start] = -1, -1
            start = e
        rank, made, where = self.rank, self.made, {}
        for i in range(n - 1):
            if after[i] >= 0 and (r := rank.get((symbols[i], symbols[i + 1]))) is not None:
                where.setdefault(r, []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            (a, b), new = self.pair[r], made[r]
            at = where.pop(r)
            at.sort()
            for i in at:
                if symbols[i] != a or (j := after[i]) < 0 or symbols[j] != b:
                    continue  # one of the two went into an earlier merge
                symbols[i], symbols[j] = new, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (s := rank.get((new, symbols[k]))) is not None:
                        if s not in where:
                            where[s] = []
                            heapq.heappush(active, s)
                        where[s].append(i)
                if (h := before[i]) >= 0 and (s := rank.get((symbols[h], new))) is not None:
                    if s not in where:
                        where[s] = []
                        heapq.heappush(active, s)
                    where[s].append(h)
        out, start = [], 0
        for e in ends:
            out.append([s for s in symbols[start:e] if s >= 0])
            start = e
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of every text; a null or empty text has none."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(p for ps in cut for p in ps if p not in self.known))
        part: list[str] = []
        size = 0
        for p in [*fresh, None]:
            if p is None or size > AT_ONCE:
                self.known.update(zip(part, self.merge(part)))
                part, size = [], 0
            if p is not None:
                part.append(p)
                size += len(p)
        known = self.known
        return [[i for p in ps for i in known[p]] for ps in cut]


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> PairIndex:
    return PairIndex(vocabulary)


def token_ids(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, ids): ids of every document's text, one row for every row.

    ``vocabulary_path`` is read on the driver; its text (a fixed file of a few
    MB) goes to the tasks as a broadcast. Null and empty texts have an empty list;
    strings that name special tokens are ordinary text. A null doc_id stays null;
    repeated rows are encoded each; other columns are not read.
    """
    spark = documents.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(shared.value)
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": own.encode(part["text"].tolist())})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.rdd.getNumPartitions() < width(spark):
        rows = rows.repartition(width(spark))
    return rows.mapInPandas(run, "doc_id long, ids array<int>")
