"""Physical plans: what is read, pushed down, shuffled and broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from corvane.operators.conversations import chat_prompts, history_prompts, history_segments, turn_pairs
from corvane.operators.examples import render, validate
from corvane.operators.ingest import ingest
from corvane.operators.ngram import fit_ngram, ngram_nll
from corvane.operators.ordered import next_row
from corvane.operators.sampling import train_eval_split
from corvane.operators.stats import length_stats
from corvane.operators.telemetry import early_stop
from corvane.operators.tokens import encode, fit_vocab, tokenize
from corvane.session import staged


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


def count(plan, word):
    return len(re.findall(rf"(?<!Reused){word} ", plan))


@pytest.fixture(scope="module")
def talks(spark):
    rows = spark.range(4000).select(
        F.floor(F.col("id") / 8).alias("conv_id"),
        (F.col("id") % 8).alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
    )
    return staged(rows, "talks")


@pytest.mark.parametrize("operator", [turn_pairs, history_prompts, chat_prompts, history_segments])
def test_short_conversations_take_one_shuffle(talks, operator):
    plan = final_plan(operator(talks))
    assert count(plan, "FileScan") == 1 and count(plan, "Exchange") == 1
    assert "Join" not in plan


def test_later_chunks_are_pushed_to_the_scan(talks):
    plan = plan_of(next_row(talks, ["conv_id"], "turn", ["role"], 4096))
    assert "GreaterThanOrEqual(turn,4096)" in plan


def test_sampling_reads_the_key_only(spark):
    df = staged(spark.range(500).withColumn("payload", F.lit("x")), "rows")
    schemas = re.findall(r"ReadSchema: (\S+)", plan_of(train_eval_split(df, "id", 0.1, 7)))
    assert schemas.count("struct<id:bigint,payload:string>") == 1
    assert schemas.count("struct<id:bigint>") == len(schemas) - 1 >= 3


def test_records_are_parsed_once(spark):
    lines = staged(spark.range(50).select("id", F.lit('{"text": "a"}').alias("line")), "lines")
    plan = plan_of(validate(render(ingest(lines).good, "id"), 10))
    assert plan.count(r'{"\u0001":"') == 1  # the mark behind a line, which only the parse writes
    assert "Exchange" not in plan and "Python" not in plan


def test_encoding_stays_in_place(spark, talks):
    tokens = tokenize(talks, None)
    plan = plan_of(encode(tokens, fit_vocab(tokens, 100))).split("Subquery")[0]
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


def test_length_statistics_order_a_histogram(spark):
    df = spark.range(0, 1000, 1, 4).select((F.col("id") % 50).alias("len"))
    plan = plan_of(length_stats(df, "len"))
    single = plan.index("SinglePartition")
    assert "HashAggregate(keys=[len" in plan[single:]


def test_early_stop_reads_the_metrics_twice(spark):
    """Once to count rows per run, once to store the metric's rows in chunks."""
    rows = spark.range(500).selectExpr("'a' AS run", "id * 1000 AS step", "'loss' AS metric", "(id * 37 % 101) / 100D AS value")
    path = staged(rows, "metrics").inputFiles()[0].rsplit("/", 1)[0]
    table = spark.read.parquet(path)
    plan = plan_of(early_stop(table, "loss", 3, size=64))
    assert path.rsplit("/", 1)[-1] not in plan  # what runs last reads the stored chunks only


def test_counts_are_cut_to_what_is_asked(spark):
    """A few texts are scored without shuffling the counts of the corpus."""
    corpus = spark.range(400).selectExpr("id", "concat_ws(' ', 'w' || id % 97, 'w' || id % 89, 'x') AS text")
    model = fit_ngram(corpus)
    asked = spark.createDataFrame([(1, "w1 w2 x")], "key long, text string")
    out = ngram_nll(asked, model, "key")
    stored = model.pairs.inputFiles()[0].rsplit("/", 2)[-2]
    assert out.count() == 1 and stored not in plan_of(out)
