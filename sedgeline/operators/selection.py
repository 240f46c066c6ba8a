"""Exact hash-ordered selection that never sorts a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.session import cut, maybe_broadcast

#: Hex digits of the hash that name a bucket; a group of a thousand million rows has about 15,000 in one.
DIGITS = 4


def smallest_hashes(rows: DataFrame, groups: list[str], hash_hex: str, tie: str, quotas: DataFrame | None = None, quota: str = "quota", permille: int = 0) -> DataFrame:
    """The ``quota`` rows of every group with the smallest (hash, tie).

    ``rows``: one row per candidate. ``quotas``: groups and ``quota``; without
    it each group's quota is ceil(permille / 1000 x its size). Method: count rows by group
    and leading hash digits (combined map-side), find in the running count the
    one bucket in which the quota is used up, take every row of the buckets
    before it and rank only the rows of that bucket. So a group that holds a
    third of all rows costs one bucket's sort and no single task.
    Groups that are null match null quotas; groups without quota give no rows.
    """
    near, b, drop = _bounded(rows, groups, hash_hex, quotas, quota, permille, "inner")
    near = near.where(F.col(b) <= F.col("__edge"))
    before = near.where(F.col(b) < F.col("__edge")).drop(*drop)
    at = near.where((F.col(b) == F.col("__edge")) & (F.col("__rest") > 0)).withColumn("__rn", F.row_number().over(Window.partitionBy(*groups).orderBy(hash_hex, tie)))
    return before.unionByName(at.where(F.col("__rn") <= F.col("__rest")).drop("__rn", *drop))


def marked_hashes(rows: DataFrame, groups: list[str], hash_hex: str, tie: str, quotas: DataFrame | None = None, quota: str = "quota", permille: int = 0) -> DataFrame:
    """Every row with ``taken``: whether ``smallest_hashes`` takes it; the rows of one bucket are ranked, the others only compared."""
    near, b, drop = _bounded(rows, groups, hash_hex, quotas, quota, permille, "left")
    at_edge = F.col(b).eqNullSafe(F.col("__edge"))
    sure = near.where(~at_edge).withColumn("taken", F.coalesce(F.col(b) < F.col("__edge"), F.lit(False))).drop(*drop)
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(hash_hex, tie))
    return sure.unionByName(near.where(at_edge).withColumn("taken", rank <= F.col("__rest")).drop(*drop))


def _bounded(rows: DataFrame, groups: list[str], hash_hex: str, quotas: DataFrame | None, quota: str, permille: int, how: str) -> tuple[DataFrame, str, list[str]]:
    """Rows with their bucket, the bucket in which their group's quota ends and how many of it are taken; helper columns to drop."""
    b = "__bucket"
    rows = rows.withColumn(b, F.conv(F.substring(hash_hex, 1, DIGITS), 16, 10).cast("int"))
    hist = rows.groupBy(*groups, b).agg(F.count("*").alias("__n"))
    run = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, 0)
    if quotas is None:
        total = Window.partitionBy(*groups)
        hist = hist.withColumn("__size", F.sum("__n").over(total)).withColumn("__q", F.expr(f"(__size * {int(permille)} + 999) div 1000")).drop("__size")
    else:
        q = quotas.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col(quota).cast("long").alias("__q"))
        on = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
        hist = hist.join(q, on, "inner").drop(*[f"__g{i}" for i in range(len(groups))])
    edge = (
        hist.withColumn("__upto", F.sum("__n").over(run))
        .where((F.col("__upto") >= F.col("__q")) | F.col("__upto").isNull())
        .groupBy(*groups)
        .agg(F.min(F.struct(b, (F.col("__q") - (F.col("__upto") - F.col("__n"))).alias("rest"))).alias("__e"))
    )
    whole = hist.groupBy(*groups).agg(F.sum("__n").alias("__size"), F.max("__q").alias("__q"))
    bounds = whole.join(edge, _same(whole, edge, groups), "left").select(
        *[whole[g].alias(f"__g{i}") for i, g in enumerate(groups)],
        F.coalesce(edge["__e"][b], F.lit(1 << (4 * DIGITS))).alias("__edge"),
        F.coalesce(edge["__e"]["rest"], F.lit(0)).alias("__rest"),
    )
    bounds = maybe_broadcast(cut(bounds), 200)
    on = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    drop = [b, "__edge", "__rest", *[f"__g{i}" for i in range(len(groups))]]
    return rows.join(bounds, on, how), b, drop


def _same(a: DataFrame, b: DataFrame, cols: list[str]):
    on = None
    for x in cols:
        e = a[x].eqNullSafe(b[x])
        on = e if on is None else on & e
    return on
