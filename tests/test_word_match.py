"""Greedy matching of words whose vectors depend on the word alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.similarity import greedy_match, greedy_word_match
from suite.scores import _make_encoder, _vectors, _words
from tests.test_plans import plan_of

ROWS = [("a b a c", "c a d"), ("", "a"), (None, "a"), ("a b", None), ("the cat", "the cat"), ("x " * 300, "y x"), ("", "")]


def test_words_match_as_their_vectors(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "id long, p string, r string").coalesce(1)
        by_vector = greedy_match(_vectors(F.col("p")), _vectors(F.col("r")))
        by_word = greedy_word_match(_words(F.col("p")), _words(F.col("r")), _make_encoder())
        out = df.select("id", by_vector.alias("v")).join(df.select("id", by_word.alias("w")), "id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(ROWS)
    for row in out:
        assert tuple(row["w"]) == pytest.approx(tuple(row["v"]), abs=1e-12)


def test_a_batch_encodes_a_word_once(spark):
    def make_encoder():
        def encode(words):
            assert len(words) == len(set(words))
            return np.eye(len(words))

        return encode

    df = spark.createDataFrame([("a a b", "b c")] * 50, "p string, r string").coalesce(1)
    out = df.select(greedy_word_match(F.split("p", " "), F.split("r", " "), make_encoder).alias("m")).distinct().collect()
    assert [tuple(r["m"]) for r in out] == [pytest.approx((1 / 3, 1 / 2, 0.4))]


def test_scores_take_one_python_step_without_vectors(spark):
    from suite.scores import _scored

    df = spark.createDataFrame([("r", 1, "p", "a b", "a c")], "run_id string, example_id long, prompt string, prediction string, reference string")
    plan = plan_of(_scored(spark, None, df))
    assert plan.count("ArrowEvalPython") == 1 and "md5" not in plan
