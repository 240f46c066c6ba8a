"""Scans: line-delimited JSON with declared types, Parquet with projection and filters, configs, plans, archives."""

from __future__ import annotations

import hashlib
import json
import lzma
import re
import shutil
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt"


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True, staging: str | None = None) -> DataFrame:
    """SRC1-4: declared columns only, as read; a line that is not an object is an error (``strict``) or kept in ``_corrupt``.

    gz and bz2 are read as they are; xz is unpacked to ``staging`` first. Blank lines are skipped.
    """
    if str(path).endswith((".xz", ".lzma")):
        if not staging:
            raise ValueError("xz needs a staging folder that all executors see")
        target = Path(staging) / (Path(path).stem + ".jsonl")
        target.parent.mkdir(parents=True, exist_ok=True)
        with lzma.open(path) as a, target.open("wb") as b:
            shutil.copyfileobj(a, b)
        path = str(target)
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    rows = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"), "value").select("r.*", "value")
    bad = F.col(BAD).isNotNull() | ~F.trim("value").startswith("{")
    if strict:
        first = schema.fields[0].name
        rows = rows.withColumn(first, F.when(bad, F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 200)))).otherwise(F.col(first)))
        return rows.drop("value", BAD)
    return rows.withColumn(BAD, F.when(bad, F.col("value"))).drop("value")


def numbered(df: DataFrame, name: str = "source_record_index") -> DataFrame:
    """SRC11: dense line numbers in file order; the only place that needs an RDD (zipWithIndex)."""
    schema = T.StructType([T.StructField(name, T.LongType(), False), *df.schema.fields])
    return df.rdd.zipWithIndex().map(lambda r: (r[1], *r[0])).toDF(schema)


def by_year(reviews: DataFrame, milliseconds: str, first: int, last: int) -> DataFrame:
    """SRC1: rows of the UTC years from first to last."""
    return reviews.where(F.year(F.timestamp_millis(F.col(milliseconds))).between(first, last))


NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def parquet_rows(spark: SparkSession, path: str, columns: list[str], filters: dict[str, object] | None = None) -> DataFrame:
    """SRC5-6: projection and equality or membership filters, pushed to the scan; an empty list matches nothing."""
    for c in [*columns, *(filters or {})]:
        if not NAME.fullmatch(c):
            raise ValueError(f"not a column name: {c!r}")
    df = spark.read.parquet(path)
    for c, v in (filters or {}).items():
        if isinstance(v, (list, tuple, set)):
            df = df.where(F.col(c).isin(*v)) if v else df.where(F.lit(False))
        else:
            df = df.where(F.col(c).eqNullSafe(F.lit(v)))
    return df.select(*columns)


def rows_of_keys(spark: SparkSession, path: str, columns: list[str], keys: DataFrame, key: str) -> DataFrame:
    """SRC6 for keys of any number: the rows whose key stands in ``keys``, by a semi join of the projected scan; a null key matches nothing."""
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    return parquet_rows(spark, path, list(dict.fromkeys([*columns, key]))).join(wanted, key, "left_semi").select(*columns)


def union_by_name(spark: SparkSession, paths: list[str], infer: bool = True, schema: T.StructType | None = None) -> DataFrame:
    """SRC4: JSON lines of several files as one table; a column that a file lacks is null there, types are inferred over all files unless given."""
    if not paths:
        raise ValueError("no files")
    if schema is not None:
        return spark.read.schema(schema).json(paths)
    if not infer:
        raise ValueError("a schema is needed where types are not inferred")
    return spark.read.json(paths)


def by_suffix(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC8: Parquet or CSV."""
    if str(path).endswith(".csv"):
        r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return (r.schema(schema) if schema else r).csv(path)
    return spark.read.parquet(path)


def config(path: str, required: set[str]) -> dict:
    """SRC12: a JSON document with known keys; unknown and missing ones are errors."""
    doc = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(doc, dict) or set(doc) != required:
        raise ValueError(f"{path}: keys {sorted(set(doc) ^ required)} are missing or unknown")
    return doc


def file_digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


def audit_archive(archive: str, ledger: dict[str, str]) -> dict[str, str]:
    """SRC14: members of a tar.gz against their sha256: ok, changed or missing."""
    out = dict.fromkeys(ledger, "missing")
    with tarfile.open(archive, "r:gz") as tar:
        for m in tar:
            if m.isfile() and m.name in ledger:
                digest = hashlib.sha256(tar.extractfile(m).read()).hexdigest()
                out[m.name] = "ok" if digest == ledger[m.name] else "changed"
    return out
