"""String expressions that follow Python's string rules inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corvane.functions import fixed


def strip(text: Column) -> Column:
    """Remove white space of any kind (not only blanks) at both ends."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def truthy(text: Column) -> Column:
    """True for a present, non-empty string; never NULL."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def shown(text: Column) -> Column:
    """A value as it reads inside a formatted string; NULL reads ``None``."""
    return F.coalesce(text, F.lit("None"))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    cased = F.transform(
        runs,
        lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(F.substr(run, F.lit(2)))),
    )
    return F.array_join(cased, "")


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for an empty text."""
    return F.regexp_count(text, F.lit(f"[^{fixed.WHITESPACE}]+"))


def word_tokens(text: Column) -> Column:
    """Default tokenizer: runs of word characters and single other signs."""
    return F.regexp_extract_all(text, F.lit(fixed.WORD_PATTERN), F.lit(0))


def overlap_words(text: Column) -> Column:
    """Lower-case ASCII letters and digits, every other run made one blank."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")


def halves(text: Column) -> Column:
    """Struct ``(prompt, reference)``: the first ``length div 2`` characters and the rest."""
    middle = F.floor(F.length(text) / 2).cast("int")
    return F.struct(
        F.substr(text, F.lit(1), middle).alias("prompt"),
        F.substr(text, middle + 1).alias("reference"),
    )


def wrap_prompt(message: Column) -> Column:
    """A single instruction, ready for the answer."""
    return F.concat(
        F.lit(fixed.INSTRUCTION_HEAD), message, F.lit("\n\n" + fixed.RESPONSE_HEAD)
    )


def extract_response(output: Column, prompt: Column) -> Column:
    """Decoded output without as many leading characters as the prompt has."""
    return strip(F.substr(output, F.length(prompt) + 1))


def run_name(
    model: Column,
    adapters: Column,
    dataset: Column,
    shard: Column,
    override: Column | None = None,
) -> Column:
    """Output name of a run; ``adapters`` is an array, empty for the base model."""
    joined = F.when(
        F.size(adapters) > 0, F.concat(F.lit("with_"), F.array_join(adapters, "_"))
    ).otherwise("base")
    name = F.concat_ws("_", model, joined, dataset, shard)
    if override is None:
        return name
    return F.when(truthy(override), override).otherwise(name)


def seeded_hash(key: Column, seed: int) -> Column:
    """Hexadecimal digest that orders rows at random but the same way everywhere."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
