"""What several of the operators share: word splitting, folds, row packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.session import staged

# Fixed values of the contracts.
BREAKS = r"\x20\x09-\x0D"  # what separates words
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def split_words(text: Column) -> Column:
    """Words as an array; NULL reads as no text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BREAKS}]+"), "")


def count_words(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BREAKS}]+")), F.lit(0)).cast("long")


def fold_of(key: Column, folds: int) -> Column:
    """Fold by the CRC-32 of the key as text; a NULL key falls in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def thinned(rows: DataFrame, key: str, by: list[str], most: int) -> DataFrame:
    """About four times ``most`` rows of every group, by a digest of the key; all of a small group.

    What comes after may then rank a group's rows in one task: their number does
    not grow with the group. Counts the groups first.
    """
    counts = staged(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")), "group-sizes")
    share = F.pmod(F.xxhash64(F.lit("thin"), F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    kept = rows.join(counts, by) if by else rows.withColumn("_rows", counts.scalar())
    return kept.filter(share * F.col("_rows") < 4.0 * most).drop("_rows")


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
