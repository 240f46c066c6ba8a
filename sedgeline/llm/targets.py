"""P1. Samples whose category shares match targets: min-cost flow on cell counts.

Per niche the records are counted in cells (the cross of stratum, rating group
and year; a record whose repeated rows differ stands in a cell of its own kind, the set
of its cells, from which any of its categories may draw it, once). A flow network carries
the sample: source -> category (its floor, its margin) -> cells of that category
(availability) -> sink. A slack arc from
each category to the sink costs more than any cell, so flow takes it only when
the category has no records left; slack on a floor costs more than slack on a
margin. Within a category the arcs of a cell are priced so that a cell first
fills the whole part of its proportional share, then cells bid for the
remaining units with keys u/fraction (u a fixed hash of cell and salt), which
draws the integer quotas at random with chances near the fractions. The
records of each cell are then taken in the order of a salted hash.

Only counts (at most the distinct cells of a niche) reach the solver; records
are selected by ``smallest_hashes`` without a per-cell sort.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.functions.text import category_key, strip
from sedgeline.operators.selection import smallest_hashes
from sedgeline.session import width

FIELDS = ("stratum_id", "rating_group", "review_year")
#: Cost of a unit that a floor, or else a margin, is short of; every cell arc is cheaper.
FLOOR_SLACK, MARGIN_SLACK = 1_000_000.0, 1_000.0


def classified(records: DataFrame) -> DataFrame:
    """(niche_id, review_id, cells): every record once, with the sorted set of its cells, an array of (stratum_id, rating_group, review_year) in comparable form.

    A null rating_group follows from the rating (1-2, 3, 4-5), a null
    review_year from the UTC year of review_timestamp, a null stratum_id from
    rating_group|review_year|length_bucket. What cannot be derived stays null
    and belongs to no category. Null or blank niche_id and review_id are left out.
    """
    r = F.col("rating")
    group = F.coalesce(
        category_key("rating_group"),
        F.when(r.isin(1.0, 2.0), "low_1_2").when(r == 3.0, "mid_3").when(r.isin(4.0, 5.0), "high_4_5"),
    )
    year = F.coalesce(category_key(F.col("review_year").cast("string")), F.year(F.to_utc_timestamp("review_timestamp", F.current_timezone())).cast("string"))
    rows = records.select(F.nullif(strip("niche_id"), F.lit("")).alias("niche_id"), F.nullif(strip("review_id"), F.lit("")).alias("review_id"), group.alias("rating_group"), year.alias("review_year"), category_key("stratum_id").alias("s"), category_key("length_bucket").alias("l"))
    built = F.concat(F.col("rating_group"), F.lit("|"), F.col("review_year"), F.lit("|"), F.col("l"))
    rows = rows.where("niche_id is not null and review_id is not null").withColumn("stratum_id", F.coalesce("s", built))
    return rows.groupBy("niche_id", "review_id").agg(F.array_sort(F.collect_set(F.struct(*FIELDS))).alias("cells"))


def cell_counts(rows: DataFrame) -> DataFrame:
    """(niche_id, cells, n): records by their set of cells."""
    return rows.groupBy("niche_id", "cells").agg(F.count("*").alias("n"))


def category_counts(counts: DataFrame) -> DataFrame:
    """(niche_id, target_field, category, records): distinct records by category, from the counts of their cells."""
    kinds = F.flatten(F.transform("cells", lambda c: F.array(*[F.struct(F.lit(f).alias("target_field"), c[f].alias("category")) for f in FIELDS])))
    return counts.select("niche_id", "n", F.explode(F.array_distinct(kinds)).alias("x")).select("niche_id", "n", "x.*").where("category is not null").groupBy("niche_id", "target_field", "category").agg(F.sum("n").alias("records"))


def normal_targets(targets: DataFrame) -> DataFrame:
    """Targets with comparable categories; repeats of one category add their permilles, keep the largest floor and size."""
    t = targets.select(F.nullif(strip("niche_id"), F.lit("")).alias("niche_id"), F.lower(strip("target_field")).alias("target_field"), F.col("category").alias("given"), category_key("category").alias("category"), *[F.coalesce(F.col(x).cast("long"), F.lit(0)).alias(x) for x in ("target_permille", "min_rows", "sample_size")])
    return t.where("niche_id is not null and category is not null").groupBy("niche_id", "target_field", "category").agg(F.min("given").alias("given"), F.sum("target_permille").alias("target_permille"), F.max("min_rows").alias("min_rows"), F.max("sample_size").alias("sample_size"))


def unit(*key: object) -> float:
    """A fixed uniform number in (0, 1)."""
    h = hashlib.blake2b("\x1f".join(map(str, key)).encode(), digest_size=8).digest()
    return (int.from_bytes(h, "big") + 0.5) / 2**64


class Network:
    """Successive shortest paths with potentials on a small graph of capacities and costs."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, cap: int, cost: float) -> int:
        k = len(self.to)
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return k

    def flow(self, k: int) -> int:
        return self.cap[k ^ 1]

    def run(self, s: int, t: int, want: int) -> int:
        """Sends up to ``want`` units at least cost; costs must be non-negative at the start."""
        n, pot, sent = len(self.out), [0.0] * len(self.out), 0
        while sent < want:
            dist, via = [math.inf] * n, [-1] * n
            dist[s] = 0.0
            heap = [(0.0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > dist[x] + 1e-12:
                    continue
                for k in self.out[x]:
                    y = self.to[k]
                    if self.cap[k] > 0 and (nd := d + self.cost[k] + pot[x] - pot[y]) < dist[y] - 1e-9:
                        dist[y], via[y] = nd, k
                        heapq.heappush(heap, (nd, y))
            if dist[t] == math.inf:
                return sent
            pot = [p + (d if d < math.inf else 0.0) for p, d in zip(pot, dist)]
            push, x = want - sent, t
            while x != s:
                push, x = min(push, self.cap[via[x]]), self.to[via[x] ^ 1]
            x = t
            while x != s:
                self.cap[via[x]] -= push
                self.cap[via[x] ^ 1] += push
                x = self.to[via[x] ^ 1]
            sent += push
        return sent


def solve(niche: str, targets: list[tuple], cells: list[tuple], salt: str) -> tuple[list[dict], list[dict]]:
    """Quotas of one niche.

    targets: (category, demand, floor, records); cells: (categories, key, n), where
    every record stands in one cell and the cell may serve several categories. Returns the
    report by category and the integer quota by category and cell. What a category
    is allotted and what it is short of add up to its demand.
    """
    net = Network(2 + 3 * len(targets) + len(cells))
    source, sink = 0, 1
    ends = {key: 2 + 3 * len(targets) + i for i, (_, key, _) in enumerate(cells)}
    for _, key, n in cells:
        net.arc(ends[key], sink, n, 0.0)
    by: dict[str, list[tuple[str, int]]] = {}
    for categories, key, n in cells:
        for c in categories:
            by.setdefault(c, []).append((key, n))
    slack, priced, total = [], [], 0
    for i, (category, demand, floor, records) in enumerate(targets):
        total += demand
        hub = 2 + 3 * i
        parts = []
        for want, price, at in ((min(floor, demand), FLOOR_SLACK, hub + 1), (demand - min(floor, demand), MARGIN_SLACK, hub + 2)):
            net.arc(source, at, want, 0.0)
            net.arc(at, hub, want, 0.0)
            parts.append(net.arc(at, sink, want, price))
        slack.append(parts)
        for key, n in by.get(category, ()):
            share = min(demand, records) * n / records if records else 0.0
            whole = min(n, int(share + 1e-9))
            arcs = [net.arc(hub, ends[key], whole, 0.0)]
            if whole < n:
                part = share - whole
                bid = unit(salt, niche, category, key) / part if part > 1e-9 else math.inf
                arcs.append(net.arc(hub, ends[key], 1, 1 + 100 * bid / (1 + bid) if bid < math.inf else 150.0))
                arcs.append(net.arc(hub, ends[key], n - whole - 1, 200.0))
            priced.append((category, key, arcs))
    net.run(source, sink, total)
    quotas = [{"category": c, "key": k, "quota": sum(net.flow(a) for a in arcs)} for c, k, arcs in priced]
    report = []
    for (category, demand, floor, records), (f, m) in zip(targets, slack):
        report.append({"category": category, "demand": demand, "available": records, "floor_short": net.flow(f), "margin_short": net.flow(m), "allotted": sum(q["quota"] for q in quotas if q["category"] == category)})
    return report, quotas


CELL, NEXT = "\x1f", "\x1e"
REPORT = "niche_id string, target_field string, category string, kind string, cell string, demand long, available long, floor_short long, margin_short long, quota long"


def cell_key(cells: str):
    """One text of a set of cells: fields and cells with separators of their own."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(CELL, *[F.coalesce(c[f], F.lit("")) for f in FIELDS])), NEXT)


def plan(records: DataFrame, targets: DataFrame, salt: str = "42") -> tuple[DataFrame, DataFrame]:
    """(rows with their cells, solved plan): the plan has a row of kind ``category`` per target and of kind ``cell`` per cell and category.

    The demand of a category is the greater of min_rows and
    floor(sample_size * target_permille / 1000). Targets of a field other than
    the three are reported as wholly short. A niche without records is short of
    all its demand; records of a niche without targets are not drawn; empty
    tables give empty plans.
    """
    rows = classified(records)
    counts = cell_counts(rows)
    asked = normal_targets(targets).join(category_counts(counts), ["niche_id", "target_field", "category"], "left").withColumn("records", F.coalesce("records", F.lit(0)))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(x) for x in names]
    both = asked.select("niche_id", F.lit(0).alias("is_cell"), "target_field", "category", "given", "target_permille", "min_rows", "sample_size", "records", *none("string", "cell")).unionByName(
        counts.join(asked.select("niche_id").distinct(), "niche_id", "left_semi").select("niche_id", F.lit(1).alias("is_cell"), *none("string", "target_field", "category", "given"), *none("long", "target_permille", "min_rows", "sample_size"), F.col("n").alias("records"), cell_key("cells").alias("cell"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        niche = pdf["niche_id"].iloc[0]
        ask, have = pdf[pdf["is_cell"] == 0], pdf[pdf["is_cell"] == 1].sort_values("cell")
        out = []
        for field, own in ask.groupby("target_field", dropna=False, sort=True):
            own = own.sort_values("category")
            wants = [(r.category, max(int(r.min_rows), int(r.sample_size) * int(r.target_permille) // 1000), int(r.min_rows), int(r.records)) for r in own.itertuples()]
            asked_for, cells = {w[0] for w in wants}, []
            if field in FIELDS:
                k = FIELDS.index(field)
                for r in have.itertuples():
                    if serves := sorted({c.split(CELL)[k] for c in r.cell.split(NEXT)} & asked_for):
                        cells.append((serves, r.cell, int(r.records)))
            report, quotas = solve(niche, wants, cells, salt)
            given = dict(zip(own["category"], own["given"]))
            out += [{"niche_id": niche, "target_field": field, "category": given[x["category"]], "kind": "category", "cell": None, "demand": x["demand"], "available": x["available"], "floor_short": x["floor_short"], "margin_short": x["margin_short"], "quota": x["allotted"]} for x in report]
            out += [{"niche_id": niche, "target_field": field, "category": given[x["category"]], "kind": "cell", "cell": x["key"], "demand": 0, "available": 0, "floor_short": 0, "margin_short": 0, "quota": x["quota"]} for x in quotas]
        return pd.DataFrame(out, columns=[x.split()[0] for x in REPORT.split(", ")])

    spread = both.repartition(width(records.sparkSession), "niche_id")  # few bytes, but each niche is work
    return rows, spread.groupBy("niche_id").applyInPandas(run, REPORT)


def shortfalls(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(niche_id, target_field, category): categories that the flow could not fill for want of records.

    A category that has the records, but shares them with others that draw
    them too, is short in the report only.
    """
    _, solved = plan(records, targets)
    return solved.where("kind = 'category' and floor_short + margin_short > 0 and available < demand").select("niche_id", "target_field", "category")


def report(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Every target with its demand, the records there are, what is short and what the sample takes."""
    _, solved = plan(records, targets)
    return solved.where("kind = 'category'").select("niche_id", "target_field", "category", "demand", "available", "floor_short", "margin_short", F.col("quota").alias("allotted"))


def sample(records: DataFrame, targets: DataFrame, salt: str = "42") -> DataFrame:
    """(niche_id, review_id, stratum_id, rating_group, review_year): the drawn records, the same in every rerun; of several cells the first."""
    rows, solved = plan(records, targets, salt)
    quotas = solved.where("kind = 'cell' and quota > 0").groupBy("niche_id", "target_field", "cell").agg(F.sum("quota").alias("quota")).groupBy("niche_id", "cell").agg(F.max("quota").alias("quota"))
    rows = rows.select("niche_id", "review_id", cell_key("cells").alias("cell"), F.col("cells")[0].alias("x"), F.md5(F.concat_ws(":", F.col("review_id"), F.lit(salt))).alias("hash"))
    return smallest_hashes(rows, ["niche_id", "cell"], "hash", "review_id", quotas).select("niche_id", "review_id", "x.*")
