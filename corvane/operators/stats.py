"""Length statistics and corpus-level quality metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from corvane.functions import fixed
from corvane.functions.scoring import length_match
from corvane.functions.text import word_count


def length_stats(df: DataFrame, length: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, mean, "median" and "p95" of a length, the latter two being the
    elements ``n div 2`` and ``int(0.95 n)`` (from 0) of the sorted lengths.

    Rows are first counted per length; what is ordered is that histogram.
    """
    by = list(by)
    histogram = df.groupBy(*by, length).agg(F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy(*by)
    upto = F.sum("rows").over(group.orderBy(length))
    placed = histogram.withColumn("upto", upto).withColumn("n", F.sum("rows").over(group))

    def element(index):
        return F.min(F.when(F.col("upto") > index, F.col(length)))

    return placed.groupBy(*by).agg(
        F.sum("rows").alias("n"),
        (F.sum(F.col(length) * F.col("rows")) / F.sum("rows")).alias("mean_len"),
        element(F.floor(F.col("n") / 2)).alias("median_len"),
        element(F.floor(F.col("n") * F.lit(0.95))).alias("p95_len"),
    )


def quality_metrics(
    scored: DataFrame, by: Sequence[str] = (), high: float = fixed.HIGH_QUALITY_FLOOR
) -> DataFrame:
    """Means, consistency, share of high scores and length ratio in one pass.

    ``scored`` has ``rougeL`` and ``bertscore`` (0-100), ``prediction`` and
    ``reference``. Without any row the three quality scores are 50.
    """
    spread = (
        (100 - F.least(F.stddev_samp("bertscore"), F.lit(100.0)))
        + (100 - F.least(F.stddev_samp("rougeL"), F.lit(100.0)))
    ) / 2
    # One row alone has no spread; least() would then take the 100.
    spread = F.when(F.count(F.lit(1)) > 1, spread)
    rows = (
        scored.withColumn("_pred_words", word_count(F.col("prediction")))
        .withColumn("_ref_words", word_count(F.col("reference")))
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("num_examples"),
            F.avg("bertscore").alias("bert_score"),
            F.avg("rougeL").alias("rouge_score"),
            spread.alias("consistency"),
            (F.avg((F.col("bertscore") >= high).cast("double")) * 100).alias("high_quality_pct"),
            F.avg("_pred_words").alias("avg_pred_words"),
            F.avg("_ref_words").alias("avg_ref_words"),
        )
    )
    ratio = F.when(F.col("avg_ref_words") > 0, F.col("avg_pred_words") / F.col("avg_ref_words")).otherwise(0.0)
    empty = F.col("num_examples") == 0
    return (
        rows.withColumn("length_ratio", ratio)
        .withColumn("length_match", length_match(F.col("length_ratio")))
        .withColumn("consistency", F.when(empty, fixed.EMPTY_QUALITY).otherwise(F.col("consistency")))
        .withColumn("high_quality_pct", F.when(empty, fixed.EMPTY_QUALITY).otherwise(F.col("high_quality_pct")))
    )


def perplexity(
    losses: DataFrame,
    by: Sequence[str] = (),
    loss: str = "loss",
    tokens: str = "n_tokens",
    default: float = fixed.EMPTY_PERPLEXITY,
) -> DataFrame:
    """Token-weighted perplexity of mean losses.

    Rows without tokens are left out. Texts but no token at all give 1; no text
    at all gives ``default``.
    """
    used = F.col(tokens) > 0
    total = F.sum(F.when(used, F.col(tokens)))
    nll = F.sum(F.when(used, F.col(loss) * F.col(tokens)))
    value = F.when(F.count(F.lit(1)) == 0, default).otherwise(F.exp(F.coalesce(nll / total, F.lit(0.0))))
    return losses.groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"),
        F.coalesce(total, F.lit(0)).alias("total_tokens"),
        value.alias("perplexity"),
    )


def exact_match(df: DataFrame, predicted: str, gold: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of equal answers in percent; 0 without rows."""
    equal = F.coalesce(F.col(predicted) == F.col(gold), F.lit(False)).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(equal) * 100, F.lit(0.0)).alias("accuracy"),
    )
