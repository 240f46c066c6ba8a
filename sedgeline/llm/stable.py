"""P3. Reproducible samples that only grow: frozen batch bottom-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.functions.text import strip
from sedgeline.operators.selection import marked_hashes


def keyed(records: DataFrame, salt: str = "42") -> DataFrame:
    """(review_id, load_batch, hash, key_wrong): one row per review, in the batch in which it first arrived.

    The hash is computed from review_id and ``salt`` and never read from
    deterministic_key: a key that is null, wrong or written differently cannot
    change the sample. ``key_wrong`` says that some non-null key is not, case
    and blanks aside, md5(review_id:sampling_seed); with a null seed no key can
    be right. A review seen again in a later batch stays in its first one. A
    review whose batches are all null forms part of one batch after all others
    (null). Null and empty ids are left out.
    """
    true_key = F.md5(F.concat(F.col("review_id"), F.lit(":"), F.col("sampling_seed").cast("string")))
    wrong = F.col("deterministic_key").isNotNull() & (~F.lower(strip("deterministic_key")).eqNullSafe(true_key))
    rows = records.select("review_id", F.col("load_batch").cast("long").alias("load_batch"), wrong.alias("wrong")).where(F.length(strip("review_id")) > 0)
    one = rows.groupBy("review_id").agg(F.min("load_batch").alias("load_batch"), F.max("wrong").alias("key_wrong"))
    return one.withColumn("hash", F.md5(F.concat_ws(":", F.col("review_id"), F.lit(salt))))


def frozen_batches(records: DataFrame, permille: int = 100, salt: str = "42") -> DataFrame:
    """(review_id, load_batch, key_wrong, taken): every review once, and whether the sample takes it.

    Of each batch the ceil(permille/1000 x size) reviews with the smallest hashes
    are taken. A batch is immutable once the next one arrives, so its choice never
    changes and the union over batches is append-only. Ties of the hash fall to
    the smaller review_id. An empty table gives no rows.
    """
    return marked_hashes(keyed(records, salt), ["load_batch"], "hash", "review_id", permille=permille).select("review_id", "load_batch", "key_wrong", "taken")


def frozen_sample(records: DataFrame, permille: int = 100, salt: str = "42") -> DataFrame:
    """(review_id, load_batch): the reviews that ``frozen_batches`` takes."""
    return frozen_batches(records, permille, salt).where("taken").select("review_id", "load_batch")


def unreliable(records: DataFrame, permille: int = 100) -> DataFrame:
    """(review_id): reviews whose given key the sample must not trust, of those it takes and those it leaves."""
    return frozen_batches(records, permille).where("key_wrong").select("review_id")
