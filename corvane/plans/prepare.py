"""From lines to padded training batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corvane.functions import fixed
from corvane.functions.records import render_record
from corvane.operators.batches import length_batches, lm_labels, pad_batches
from corvane.operators.examples import overlong, usable
from corvane.operators.ingest import count_reasons, with_record
from corvane.operators.once import once
from corvane.operators.sampling import sample_n, train_eval_split
from corvane.operators.tokens import encode, fit_vocab, tokenize
from corvane.session import staged


@dataclass(frozen=True)
class PrepareOptions:
    max_length: int = 1536
    max_samples: int | None = None
    eval_ratio: float = 0.05
    seed: int = 42
    vocab_size: int = 32_000
    batch_size: int = 16
    pad_multiple: int = 64
    answer_keys: tuple[str, ...] = ("output",)
    permissive: bool = False


@dataclass(frozen=True)
class Prepared:
    """Every stage; records, tokens, vocabulary and ids are stored, the rest is lazy."""

    rejects: DataFrame
    counts: DataFrame
    examples: DataFrame
    vocab: DataFrame
    tokenized: DataFrame
    batches: DataFrame
    eval_batches: DataFrame


def prepare(lines: DataFrame, key: str, options: PrepareOptions = PrepareOptions()) -> Prepared:
    """``lines`` has the unique ``key`` and ``line``. Runs the jobs that store the stages.

    Lines are parsed and rendered once, texts are tokenized once. Sampling and
    splitting read only two narrow columns of the stored records, the vocabulary
    counts whole texts, and batches read only the stored ids. Records of any
    shape are kept unless ``permissive`` asks for the known training shapes.
    """
    kept, text = F.col("reason").isNull(), F.col("text")
    rendered = render_record(F.col("record"), options.answer_keys)
    records = once(with_record(lines, permissive=options.permissive), text=F.when(kept, rendered)).select(
        key,
        "reason",
        usable(text).alias("usable"),
        overlong(text, options.max_length).alias("overlong"),
        F.when(~kept, F.col("line")).alias("line"),
        "text",
    )
    records = staged(records, "records")
    examples = records.filter("usable").select(key, "overlong", "text")
    if options.max_samples is not None:
        examples = sample_n(examples, key, options.max_samples, options.seed)
    examples = train_eval_split(examples, key, options.eval_ratio, options.seed)
    tokens = staged(tokenize(examples, None).drop("text", "attention_mask"), "tokens")
    vocab = staged(fit_vocab(tokens.filter(F.col("split") == "train"), options.vocab_size), "vocabulary")
    cut = tokens.withColumn("tokens", F.slice("tokens", 1, options.max_length))
    cut = cut.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("tokens")))
    tokenized = staged(encode(cut, vocab).drop("tokens"), "tokenized")

    def batches(split: str) -> DataFrame:
        rows = tokenized.filter(F.col("split") == split)
        grouped = length_batches(rows, key, options.batch_size, seed=options.seed)
        padded = pad_batches(grouped, options.pad_multiple)
        return padded.withColumn("labels", lm_labels(F.col("padded_ids"), fixed.PAD_ID))

    rejects = records.filter(~kept).select(key, "reason", "line")
    return Prepared(
        rejects, count_reasons(records), examples, vocab, tokenized, batches("train"), batches("eval")
    )
