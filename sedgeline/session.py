"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables of this process in the checkpoint folder.
CUTS: set[str] = set()


def session(app: str = "sedgeline", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; size-dependent settings stay with the cluster."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one is made only in local mode (tests), where it is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sedgeline-ckpt-")
        sc.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared checkpoint folder and go on from the files.

    Columns are compressed there, and lineage ends. ``drop_cut`` removes a table
    that nothing reads any more; the others go when the process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    if not CUTS:
        atexit.register(clear, spark)
    CUTS.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a frame that ``cut`` returned; no frame that reads them may be used afterwards."""
    if path := getattr(df, "_cut_path", None):
        remove(df.sparkSession, path)
        CUTS.discard(path)


def clear(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        for path in CUTS:
            remove(spark, path)


def width(spark: SparkSession) -> int:
    """Tasks that a Python stage is spread over, at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def small_enough(df: DataFrame, row_bytes: int, limit: int = 8 << 20) -> bool:
    """Whether a (cheap, already cut) frame is proven to stay under ``limit`` bytes when broadcast."""
    return df.limit(limit // row_bytes + 1).count() <= limit // row_bytes


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = 8 << 20) -> DataFrame:
    """Broadcast only behind a row count; beyond it the join shuffles and AQE splits skewed keys."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their place from 1 in a total order, sorted by ranges in all tasks; only the sizes of the ranges meet in one."""
    at = F.monotonically_increasing_id()
    rows = cut(df.orderBy(*order).withColumn("__at", at))
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.partitionBy().orderBy("__part")) - F.col("__n")).alias("__before"))
    inner = F.col("__at") - F.shiftleft(F.col("__part"), 33)
    return rows.join(maybe_broadcast(before, 40), "__part").withColumn(name, F.col("__before") + inner + 1).drop("__part", "__before", "__at")
