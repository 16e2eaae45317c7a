"""From raw documents to packed training sequences, in five stages.

Each stage is one operator of ``corvane.llm``; its result is written to the
shared folder and read again as the next one's documents. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import language, mixing, packing, quality_rules, simhash
from corvane.llm.common import fold_of
from corvane.session import staged

TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters or unlike any language go."""
    learn = fold_of(F.col("doc_id"), 5) != 0
    return language.identified(docs, language.fit(docs, learn))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that line-first cleaning keeps, with their failing lines removed."""
    kept = quality_rules.judged(docs).filter("kept")
    fresh = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return kept.select(*[fresh.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of 3-word shingles link at two or fewer differing bits."""
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("SimHash near-dedup", remove_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Hashes of shingles, language models and token ids are beyond SQL; a brute-force run checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + "-".join(name.split()))
    return STAGES[-1][1](spark, docs, sf_dir)
