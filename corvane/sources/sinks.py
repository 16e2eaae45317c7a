"""Writers of scores, summaries and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SUMMARY_SCHEMA = (
    "run_id string, model string, adapters array<string>, dataset string, shard string, num_examples bigint, overall_score double, quality_grade string, "
    "bert_score double, rouge_score double, perplexity_generated double, "
    "perplexity_reference double, perplexity_score double, consistency_score double, "
    "high_quality_percentage double, "
    "score_breakdown map<string,struct<score:double,weight:double,contribution:double>>, "
    "statistics map<string,double>"
)
# Quotes are doubled and blanks kept, so texts come back as they were.
_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_scores(df: DataFrame, path: str) -> None:
    """Per-example CSV; line breaks and quotes in texts survive a read back."""
    df.write.options(**_CSV).mode("overwrite").csv(path)


def read_scores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.options(**_CSV, multiLine="true").schema(schema).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_summaries(spark: SparkSession, pattern: str, schema: str = SUMMARY_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(pattern)


def write_transcripts(df: DataFrame, path: str, per_conversation: bool = False) -> None:
    """Transcripts as JSON rows ``(conv_id, part, transcript)``.

    ``per_conversation`` writes plain text below ``conv_id=.../part=...``, one
    directory each: for a selection of conversations, not for all of a big table.
    """
    if not per_conversation:
        df.select("conv_id", "part", "transcript").write.mode("overwrite").json(path)
        return
    # The text writer ends every row with a line break of its own.
    text = F.regexp_replace("transcript", "\n$", "").alias("value")
    rows = df.select("conv_id", "part", text)
    rows.write.mode("overwrite").partitionBy("conv_id", "part").text(path)
