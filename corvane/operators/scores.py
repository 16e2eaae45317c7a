"""From predictions to graded, comparable run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corvane.functions import fixed
from corvane.functions.scoring import clamp_score, final_score, grade, ppl_score, two_decimals
from corvane.functions.similarity import greedy_match, rouge_l
from corvane.operators.once import once
from corvane.operators.ordered import Running, running


def attach_predictions(pairs: DataFrame, predictions: DataFrame, key: str = "example_id") -> DataFrame:
    """Join by example key (the reference answers and the predictions may come
    from different jobs); unanswered pairs drop out."""
    return pairs.join(predictions, key)


def score_rows(
    df: DataFrame,
    *keep: str,
    pred_vectors: str | None = None,
    ref_vectors: str | None = None,
    match: Column | None = None,
) -> DataFrame:
    """One scored row per prediction, scores on the 0-100 scale.

    The match is that of two columns of vectors, or ``match`` (a struct as from
    ``greedy_word_match``).
    """
    if match is None:
        df = once(df, _pred=F.col(pred_vectors), _ref=F.col(ref_vectors))
        match = greedy_match(F.col("_pred"), F.col("_ref"))
    raw = df.select(
        *keep,
        "prompt",
        "reference",
        "prediction",
        rouge_l(F.col("prediction"), F.col("reference")).alias("_rouge"),
        match["f1"].alias("_match"),
    )
    return raw.select(
        *keep,
        "prompt",
        "reference",
        "prediction",
        (F.col("_rouge") * 100).alias("rougeL"),
        (F.col("_match") * 100).alias("bertscore"),
        final_score(F.col("_rouge"), F.col("_match")).alias("final_score"),
    )


def profiles(spark: SparkSession) -> DataFrame:
    """Built-in ``(profile, metric, weight)`` rows."""
    rows = [(p, m, w) for p, weights in fixed.WEIGHTS.items() for m, w in weights]
    return spark.createDataFrame(rows, "profile string, metric string, weight double")


def normalise_weights(weights: DataFrame, by: Sequence[str] = ("profile",)) -> DataFrame:
    """Scale the weights of each profile to sum 1 unless they already do."""
    total = F.sum("weight").over(Window.partitionBy(*by))
    close = F.abs(total - 1.0) <= 1e-8 + 1e-5
    return weights.withColumn(
        "weight", F.when(close, F.col("weight")).otherwise(F.col("weight") / total)
    )


def long_scores(df: DataFrame, by: Sequence[str], metrics: dict[str, str]) -> DataFrame:
    """Rows ``(by..., metric, score)`` from one column per metric."""
    entries = [F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("score")) for m, c in metrics.items()]
    return df.select(*by, F.inline(F.array(*entries)))


def profile_scores(df: DataFrame, by: Sequence[str], metrics: dict[str, str], perplexity: str) -> DataFrame:
    """``long_scores`` for every profile, each with its own perplexity formula."""
    entries = [
        F.struct(
            F.lit(profile).alias("profile"),
            F.lit(metric).alias("metric"),
            (
                ppl_score(F.col(perplexity), profile)
                if metric == "Perplexity"
                else F.col(metrics[metric]).cast("double")
            ).alias("score"),
        )
        for profile, weights in fixed.WEIGHTS.items()
        for metric, _ in weights
    ]
    return df.select(*by, F.inline(F.array(*entries)))


def attach_weights(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Add each metric's weight, 0 where there is none."""
    return scores.join(weights, "metric", "left").withColumn(
        "weight", F.coalesce("weight", F.lit(0.0))
    )


def breakdown(
    scores: DataFrame, weights: DataFrame, by: Sequence[str] = (), profile: str | None = "v3"
) -> DataFrame:
    """Clamped score, weight and contribution of every metric.

    With ``profile=None`` the scores have a ``profile`` column and each profile
    keeps the metrics it weighs.
    """
    clamped = scores.withColumn("score", clamp_score(F.col("score")))
    if profile is None:
        rows = clamped.join(weights, ["profile", "metric"])
        keep = [*by, "profile"]
    else:
        rows = attach_weights(clamped, weights.filter(F.col("profile") == profile).drop("profile"))
        keep = list(by)
    return rows.select(
        *keep, "metric", "score", "weight", (F.col("score") * F.col("weight")).alias("contribution")
    )


def display_breakdown(rows: DataFrame) -> DataFrame:
    """The breakdown as printed: two decimals, weights in percent."""
    return (
        rows.withColumn("score", F.format_number("score", 2))
        .withColumn("weight", F.concat(F.format_number(F.col("weight") * 100, 2), F.lit("%")))
        .withColumn("contribution", F.format_number("contribution", 2))
    )


def overall(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of the contributions, each rounded to two decimals first, clamped."""
    total = F.sum(two_decimals(F.col("contribution"))).cast("double")
    return rows.groupBy(*by).agg(clamp_score(total).alias("overall_score"))


def summarise(rows: DataFrame, metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """One summary per run: metrics, overall score, grade, map of the breakdown.

    The breakdown stores contributions as they are, the total uses rounded ones.
    """
    entry = F.struct("score", "weight", "contribution")
    per_run = rows.groupBy(*by).agg(
        clamp_score(F.sum(two_decimals(F.col("contribution"))).cast("double")).alias("overall_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", entry.alias("part"))))).alias(
            "score_breakdown"
        ),
    )
    statistics = F.create_map(
        F.lit("avg_prediction_length"),
        F.col("avg_pred_words"),
        F.lit("avg_reference_length"),
        F.col("avg_ref_words"),
        F.lit("length_ratio"),
        F.col("length_ratio"),
    )
    joined = per_run.join(metrics, list(by))
    return joined.select(
        *by,
        "num_examples",
        "overall_score",
        grade(F.col("overall_score")).alias("quality_grade"),
        "bert_score",
        "rouge_score",
        "perplexity_generated",
        "perplexity_reference",
        "perplexity_score",
        F.col("consistency").alias("consistency_score"),
        F.col("high_quality_pct").alias("high_quality_percentage"),
        "score_breakdown",
        statistics.alias("statistics"),
    )


def identify_runs(
    summaries: DataFrame, model: str, adapters: Sequence[str], dataset: str, shard: str | None
) -> DataFrame:
    """Add what was evaluated on what: ``model, adapters, dataset, shard``."""
    return summaries.withColumns(
        {
            "model": F.lit(model),
            "adapters": F.array(*map(F.lit, adapters)).cast("array<string>"),
            "dataset": F.lit(dataset),
            "shard": F.lit(shard).cast("string"),
        }
    )


def compare_runs(summaries: DataFrame, base: str, run: str = "run_id") -> DataFrame:
    """Every run's metrics with their difference from the base run.

    The base is one row, taken as a struct by a scalar subquery.
    """
    metrics = ["overall_score", "bert_score", "rouge_score", "perplexity_generated"]
    base_row = (
        summaries.filter(F.col(run) == base)
        .agg(F.first(F.struct(*metrics)).alias("base"))
        .scalar()
    )
    with_base = summaries.select(run, *metrics).withColumn("base", base_row)
    return with_base.select(
        run, *metrics, *[(F.col(m) - F.col("base")[m]).alias(f"{m}_delta") for m in metrics]
    )


def retention(
    scores: DataFrame, by: Sequence[str], stage: str, score: str, tolerance: float = 0.05
) -> DataFrame:
    """Compare each stage's score in a domain with the domain's first stage.

    ``stage`` is a whole number; ``retained`` is false where more than
    ``tolerance`` of the first score is lost.
    """
    out = running(scores, by, stage, {"first_score": Running("first", F.col(score))})
    return out.withColumn("retained", F.col(score) >= F.col("first_score") * (1 - tolerance))
