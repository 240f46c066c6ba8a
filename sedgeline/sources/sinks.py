"""Sinks: atomic Parquet folders, several at once, CSV safe for spreadsheets, reports."""

from __future__ import annotations

import json
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.functions.text import spreadsheet_safe


def _fs(df: DataFrame, path: str):
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def write_parquet(df: DataFrame, path: str, partitions: list[str] | None = None, order: list[str] | None = None, group_bytes: int | None = None) -> str:
    """SNK1-3: the whole folder is written beside the target and renamed, so that readers never see a part of it."""
    return write_all({path: df}, partitions, order, group_bytes)[0]


def write_all(frames: dict[str, DataFrame], partitions: list[str] | None = None, order: list[str] | None = None, group_bytes: int | None = None) -> list[str]:
    """SNK2, SNK4: several folders replaced together; what was there comes back if any step fails.

    All are written before the first is replaced. With ``order`` files hold ranges of it, each sorted, so that
    readers skip row groups (of ``group_bytes``) by their bounds. Works on every file system that Hadoop knows.
    """
    tag, moved, done = uuid.uuid4().hex[:12], [], []
    try:
        for path, df in frames.items():
            if order:
                df = df.repartitionByRange(*order).sortWithinPartitions(*order)
            w = df.write.option("compression", "zstd")
            w = w.option("parquet.block.size", group_bytes) if group_bytes else w
            (w.partitionBy(*partitions) if partitions else w).parquet(f"{path}.new-{tag}")
        for path, df in frames.items():
            fs, p, make = _fs(df, path)
            if fs.exists(p):
                fs.rename(p, make(f"{path}.old-{tag}"))
                moved.append(path)
            fs.rename(make(f"{path}.new-{tag}"), p)
            done.append(path)
    except Exception:
        for path, df in frames.items():
            fs, p, make = _fs(df, path)
            if path in done:
                fs.delete(p, True)
            if path in moved:
                fs.rename(make(f"{path}.old-{tag}"), p)
            fs.delete(make(f"{path}.new-{tag}"), True)
        raise
    for path in moved:
        fs, _, make = _fs(frames[path], path)
        fs.delete(make(f"{path}.old-{tag}"), True)
    return list(frames)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK5, SNK9: CSV whose texts no spreadsheet runs as formulas; nested columns as JSON."""
    columns = []
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            columns.append(spreadsheet_safe(f.name).alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            columns.append(F.to_json(f.name).alias(f.name))
        else:
            columns.append(F.col(f.name))
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(report: dict, path: str) -> None:
    """SNK8: a JSON document, replaced as a whole."""
    new = Path(f"{path}.new-{uuid.uuid4().hex[:12]}")
    new.write_text(json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")
    shutil.move(new, path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """SNK7: the first rows of a report frame as a Markdown table."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"
