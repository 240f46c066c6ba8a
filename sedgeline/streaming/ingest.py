"""Reviews and events as they arrive (an extension: the batch operators applied to streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.operators.ingest import DEDUP_KEY, transform


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", files: int = 100) -> DataFrame:
    """New files of a folder, at most ``files`` in a micro-batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(folder)


def canonical_stream(raw: DataFrame, version: str, category: str, first_day: str, last_day: str, late: str = "2 days") -> DataFrame:
    """Valid canonical reviews of a raw stream, repeats dropped while the watermark keeps their key."""
    valid = transform(raw, version, category, first_day, last_day).where("drop_reason is null").drop("drop_reason")
    return valid.withWatermark("review_timestamp", late).dropDuplicatesWithinWatermark(list(DEDUP_KEY))


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and keys; a window comes out once, when the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there, to an in-memory table (for tests)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def publish(stream: DataFrame, path: str, checkpoint: str):
    """Append to Parquet, each micro-batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
