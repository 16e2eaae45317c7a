"""From predictions to run summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions import fixed
from corvane.functions.scoring import ppl_score, recommendations
from corvane.functions.text import seeded_hash, strip
from corvane.operators.ngram import Bigrams, ngram_nll
from corvane.operators.sampling import sample_n_by
from corvane.operators.examples import min_chars
from corvane.operators.scores import breakdown, long_scores, normalise_weights, overall, profiles, summarise
from corvane.operators.stats import perplexity, quality_metrics
from corvane.session import staged

METRICS = {
    "BERTScore": "bert_score",
    "ROUGE-L": "rouge_score",
    "Consistency": "consistency",
    "High Quality %": "high_quality_pct",
    "Perplexity": "perplexity_score",
}


@dataclass(frozen=True)
class Evaluated:
    metrics: DataFrame
    breakdown: DataFrame
    overall: DataFrame
    summary: DataFrame
    advice: DataFrame


def text_perplexity(
    texts: DataFrame,
    model: Bigrams,
    key: str,
    text: str,
    by: Sequence[str],
    sample: int | None = None,
    seed: int = 42,
    max_tokens: int | None = None,
) -> DataFrame:
    """Perplexity per run of a text column, optionally of a seeded sample per run."""
    used = min_chars(texts, text)
    if sample is not None:
        used = sample_n_by(used, list(by), key, sample, seed)
    return perplexity(ngram_nll(used, model, key, *by, text=text, max_tokens=max_tokens), by)


def run_perplexities(
    answered: DataFrame,
    model: Bigrams,
    key: str,
    by: Sequence[str] = ("run_id",),
    sample: int | None = None,
    seed: int = 42,
    max_tokens: int | None = None,
) -> DataFrame:
    """``perplexity_generated`` and ``perplexity_reference`` of every run.

    Predictions below five characters are left out. Both sides are scored in one
    pass, so the model's counts are joined once. All texts are taken;
    ``sample`` draws at most so many generated ones of a run, and as many
    references as there are generated ones in the draw.
    """
    by = list(by)
    sides = F.array(
        *[
            F.struct(F.lit(side).alias("side"), F.col(column).alias("text"))
            for side, column in (("generated", "prediction"), ("reference", "reference"))
        ]
    )
    texts = answered.select(key, *by, F.inline(sides))
    texts = texts.filter((F.col("side") == "reference") | (F.length(strip(F.col("text"))) >= 5))
    if sample is not None:
        named = texts.withColumn("_name", F.concat_ws(":", "side", F.col(key).cast("string")))
        drawn = sample_n_by(named, [*by, "side"], "_name", sample, seed)
        # A run has at most ``sample`` rows of a side here.
        size = F.count_if(F.col("side") == "generated").over(Window.partitionBy(*by))
        place = F.row_number().over(Window.partitionBy(*by, "side").orderBy(seeded_hash(F.col("_name"), seed)))
        drawn = drawn.withColumn("_size", size).withColumn("_place", place)
        texts = drawn.filter(F.col("_place") <= F.col("_size")).drop("_name", "_size", "_place")
    losses = ngram_nll(texts, model, key, *by, "side", max_tokens=max_tokens)
    found = perplexity(losses, [*by, "side"])

    def of(side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("perplexity"))).alias(f"perplexity_{side}")

    return found.groupBy(*by).agg(of("generated"), of("reference"))


def evaluate(scored: DataFrame, perplexities: DataFrame, by: Sequence[str] = ("run_id",)) -> Evaluated:
    """``scored`` as from ``score_rows``; ``perplexities`` has the run key,
    ``perplexity_generated`` and ``perplexity_reference`` (100 where missing)."""
    by = list(by)
    metrics = quality_metrics(scored, by).join(perplexities, by, "left")
    # Without generated texts neither perplexity is computed.
    known = F.col("perplexity_generated").isNotNull()
    for name in ("perplexity_reference", "perplexity_generated"):
        value = F.coalesce(F.when(known, F.col(name)), F.lit(fixed.EMPTY_PERPLEXITY))
        metrics = metrics.withColumn(name, value)
    metrics = metrics.withColumn("perplexity_score", ppl_score(F.col("perplexity_generated")))
    # A row per run, from one pass over the scored rows; used three times below.
    metrics = staged(metrics, "run-metrics")
    weights = normalise_weights(profiles(scored.sparkSession))
    rows = breakdown(long_scores(metrics, by, METRICS), weights, by)
    advice = metrics.select(
        *by,
        recommendations(**{name: F.col(name) for name in fixed.ADVICE}).alias("recommendations"),
    )
    return Evaluated(metrics, rows, overall(rows, by), summarise(rows, metrics, by), advice)
