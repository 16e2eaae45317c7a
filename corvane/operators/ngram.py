"""Corpus-fitted bigram model and per-text negative log-likelihood."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corvane.functions.text import word_tokens
from corvane.operators.once import once
from corvane.operators.top import most_frequent
from corvane.session import staged

START = "<s>"
HOT_ROWS = 10_000
TEXT = 32 << 20  # about so many bytes of text are counted by one task


@dataclass(frozen=True)
class Bigrams:
    """``pairs(w1, w2, n)``, ``contexts(w1, n)``, one-row ``vocabulary(v)``, smoothing ``k``."""

    pairs: DataFrame
    contexts: DataFrame
    vocabulary: DataFrame
    k: float


def _bigrams(df: DataFrame, text: str, max_tokens: int | None = None) -> DataFrame:
    """Add ``bigrams``: an array of ``(w1, w2)`` per token, the first with the start mark."""
    tokens = word_tokens(F.lower(F.col(text)))
    if max_tokens is not None:
        tokens = F.slice(tokens, 1, max_tokens)
    before = F.concat(F.array(F.lit(START)), F.slice("_words", 1, F.size("_words")))
    both = F.arrays_zip(F.slice(before, 1, F.size("_words")).alias("w1"), F.col("_words").alias("w2"))
    return once(df, _words=tokens).withColumn("bigrams", both)


def _dealt(df: DataFrame, text: str) -> DataFrame:
    """The texts in shares of ``TEXT`` where their splits hold more, so that the counts a task combines stay bounded."""
    texts = df.select(text)
    total = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = -(-total // TEXT)
    return texts.repartition(tasks) if tasks > texts.rdd.getNumPartitions() else texts


def fit_ngram(df: DataFrame, text: str = "text", k: float = 1.0) -> Bigrams:
    """Count the corpus's bigrams; counts combine before the shuffle.

    Fitting reads the corpus when called, once for its length and once for the
    counts: these and the size of the vocabulary are stored, scoring reads them.
    """
    pairs = (
        _bigrams(_dealt(df, text), text).select(F.explode("bigrams").alias("b"))
        .groupBy("b.w1", "b.w2")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = staged(pairs, "bigrams")
    contexts = staged(pairs.groupBy("w1").agg(F.sum("n").alias("n")), "contexts")
    vocabulary = pairs.select("w2").distinct().agg((F.count(F.lit(1)) + 1).alias("v"))
    vocabulary = staged(vocabulary, "vocabulary-size")
    return Bigrams(pairs, contexts, vocabulary, k)


def lookup_counts(df: DataFrame, counts: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Left join of a stored count table (unique keys, count ``n``) that frequent keys cannot skew.

    The different keys asked for, combined before their shuffle, cut the table
    down first; Spark broadcasts them when they are few, and then the counts of
    a whole corpus are read for a handful of texts without a shuffle. Of what is
    left the most frequent keys, a fixed number of rows, are broadcast. In the
    last join a row's place is the hash of its keys, but for rows already
    answered the hash of the whole row: those are spread out and match nothing.
    What is left to meet there are keys that are rare by construction.
    """
    asked = df.select(*keys).distinct()
    counts = staged(counts.join(asked, keys, "left_semi"), "asked-counts")
    hot = most_frequent(counts, HOT_ROWS, "n", *keys)
    hot = hot.select(*keys, F.col("n").alias("_hot"))
    home = F.xxhash64(*keys)
    cold = counts.select(home.alias("_place"), *keys, F.col("n").alias("_cold"))
    place = F.when(F.col("_hot").isNotNull(), F.xxhash64(*df.columns)).otherwise(home)
    return (
        df.join(F.broadcast(hot), keys, "left")
        .withColumn("_place", place)
        .join(cold, ["_place", *keys], "left")
        .withColumn(out, F.coalesce("_hot", "_cold", F.lit(0).cast("long")))
        .drop("_hot", "_cold", "_place")
    )


def ngram_nll(
    df: DataFrame,
    model: Bigrams,
    *keys: str,
    text: str = "text",
    max_tokens: int | None = None,
) -> DataFrame:
    """Per text: ``n_tokens``, summed ``nll`` and mean ``loss`` under the model.

    ``keys`` tell the texts apart (further columns to keep may be among them).
    Whole texts are scored; ``max_tokens`` cuts every text, as a model with a
    short context would.
    """
    rows = _bigrams(df, text, max_tokens).select(*keys, F.explode_outer("bigrams").alias("b"))
    rows = rows.select(*keys, "b.w1", "b.w2")
    rows = lookup_counts(rows, model.pairs, ["w1", "w2"], "pair_n")
    rows = lookup_counts(rows, model.contexts, ["w1"], "context_n")
    p = (F.col("pair_n") + model.k) / (F.col("context_n") + model.k * model.vocabulary.scalar())
    scored = rows.groupBy(*keys).agg(
        F.count("w2").alias("n_tokens"),
        F.coalesce(F.sum(F.when(F.col("w2").isNotNull(), -F.log(p))), F.lit(0.0)).alias("nll"),
    )
    return scored.withColumn(
        "loss", F.when(F.col("n_tokens") > 0, F.col("nll") / F.col("n_tokens")).otherwise(0.0)
    )
