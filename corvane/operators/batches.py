"""Length-grouped batches, padding and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions import fixed
from corvane.functions.text import seeded_hash

BATCH = ("bucket", "batch")


def length_batches(
    df: DataFrame,
    key: str,
    batch_size: int,
    ids: str = "input_ids",
    mega: int = 50,
    seed: int = 42,
) -> DataFrame:
    """Add ``bucket``, ``batch`` and ``n_ids``.

    Rows go to random buckets of about ``mega`` batches each (fewer in small
    data); inside a bucket the longest come first and every ``batch_size`` rows
    form a batch. Only a bucket's last batch can be short. One shuffle, by
    bucket, whose rows are bounded because the digest spreads unique keys.
    """
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    batches = F.least(F.greatest(F.floor(F.col("rows") / (4 * batch_size)), F.lit(1)), F.lit(mega))
    buckets = rows.select(
        F.greatest(F.ceil(F.col("rows") / (batches * batch_size)), F.lit(1)).cast("long").alias("buckets")
    )
    digest = seeded_hash(F.col(key), seed)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    placed = df.withColumn("n_ids", F.size(ids)).withColumn("bucket", number % buckets.scalar())
    order = Window.partitionBy("bucket").orderBy(F.desc("n_ids"), seeded_hash(F.col(key), seed))
    place = F.row_number().over(order) - 1
    return placed.withColumn("batch", F.floor(place / batch_size).cast("long"))


def pad_batches(
    df: DataFrame, multiple: int = 64, pad_id: int = fixed.PAD_ID, ids: str = "input_ids"
) -> DataFrame:
    """Pad every row to its batch's longest row, rounded up to ``multiple``.

    Adds ``pad_len``, ``padded_ids`` and ``padded_mask``. After
    ``length_batches`` the data is already placed by bucket: no new shuffle.
    """
    longest = F.max("n_ids").over(Window.partitionBy(*BATCH))
    missing = F.col("pad_len") - F.col("n_ids")
    return (
        df.withColumn("pad_len", (F.ceil(longest / multiple) * multiple).cast("int"))
        .withColumn("padded_ids", F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), missing)))
        .withColumn(
            "padded_mask",
            F.concat(F.array_repeat(F.lit(1), F.col("n_ids")), F.array_repeat(F.lit(0), missing)),
        )
    )


def lm_labels(ids: Column, pad_id: int = fixed.PAD_ID) -> Column:
    """Next-token labels: the ids themselves, pad positions ignored."""
    return F.transform(ids, lambda x: F.when(x == pad_id, fixed.IGNORED_LABEL).otherwise(x))


def batch_plan(df: DataFrame, batch_size: int, accumulation: int) -> DataFrame:
    """One row: batches, effective batch size, steps per epoch, share of padding."""
    per_batch = df.groupBy(*BATCH).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("n_ids").alias("ids"),
        F.sum("pad_len").alias("slots"),
    )
    total = per_batch.agg(
        F.sum("rows").alias("examples"),
        F.count(F.lit(1)).alias("batches"),
        F.sum("ids").alias("ids"),
        F.sum("slots").alias("slots"),
    )
    return total.select(
        "examples",
        "batches",
        F.lit(batch_size * accumulation).alias("effective_batch"),
        F.ceil(F.col("batches") / accumulation).alias("steps_per_epoch"),
        (1 - F.col("ids") / F.col("slots")).alias("padding_share"),
    )
