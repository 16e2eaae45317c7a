"""Score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corvane.functions import fixed


def final_score(rouge: Column, match: Column) -> Column:
    """Even blend of two scores given as fractions, on the 0-100 scale."""
    return (F.lit(0.5) * rouge + F.lit(0.5) * match) * 100


def clamp_score(score: Column) -> Column:
    """Into [0, 100]: missing becomes 0, either infinity 100.

    NaN is tested first because Spark orders it above every number.
    """
    return (
        F.when(score.isNull() | F.isnan(score), 0.0)
        .when(F.abs(score) == float("inf"), 100.0)
        .otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))
    )


def ppl_score(perplexity: Column, profile: str = "v3") -> Column:
    """Perplexity on the 0-100 scale, by the given profile's formula."""
    if profile == "v1":
        return F.greatest(F.lit(0.0), 100 - F.log(perplexity + 1) * 20)
    return 100 * F.exp(-perplexity / fixed.PERPLEXITY_DECAY[profile])


def length_match(ratio: Column) -> Column:
    """100 at equal average lengths, falling on both sides; 50 without a ratio."""
    falling = 100 * F.exp(-F.abs(F.log(ratio + 0.001)) / 0.5)
    return F.when(ratio > 0, falling).otherwise(50.0)


def two_decimals(value: Column) -> Column:
    """Value as printed with two decimals (ties decided on the binary value)."""
    return F.regexp_replace(F.format_number(value, 2), ",", "").cast("decimal(20,2)")


def grade(score: Column) -> Column:
    bands = F.when(score >= fixed.GRADES[0][0], fixed.GRADES[0][1])
    for floor, label in fixed.GRADES[1:]:
        bands = bands.when(score >= floor, label)
    return bands.otherwise(fixed.LOWEST_GRADE)


def recommendations(**metrics: Column) -> Column:
    """Array of advice from raw (unclamped) metrics named as in ``fixed.ADVICE``.

    A missing or NaN metric gives no advice.
    """
    found = []
    for name, (low, below, high, above) in fixed.ADVICE.items():
        value = F.when(~F.isnan(metrics[name]), metrics[name])
        found.append(F.when(value < low, below).when(value >= high, above))
    advice = F.array_compact(F.array(*found))
    return F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(fixed.DEFAULT_ADVICE)))
