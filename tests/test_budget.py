"""Batches by a token budget: the same predictions in the same order, much less padding."""

import random

from pyspark.sql import functions as F

from corvane.operators.predict import by_length, embed_tokens, predict


def padding(lengths, batches):
    return sum(len(b) * max(lengths[i] for i in b) - sum(lengths[i] for i in b) for b in batches)


def test_batches_hold_every_text_once_and_half_the_padding():
    draw = random.Random(4)
    lengths = [draw.choice([0, 3, draw.randint(1, 2000)]) for _ in range(4000)]
    plain = list(by_length(lengths, 16, None))
    sorted_by = list(by_length(lengths, 64, 16 * 1000))
    for batches in (plain, sorted_by):
        assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
    assert all(len(b) <= 64 and (len(b) == 1 or len(b) * max(lengths[i] for i in b) <= 16_000) for b in sorted_by)
    assert padding(lengths, sorted_by) < 0.1 * padding(lengths, plain)
    assert list(by_length([], 4, 10)) == [] and list(by_length([99], 4, 10)) == [[0]]


def test_predictions_are_the_same_and_in_order(spark):
    draw = random.Random(5)
    rows = [(i, None if i % 11 == 0 else " ".join(["w"] * draw.randint(0, 300)) + f" {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, prompt string").coalesce(1)

    def model():
        def fn(prompts):
            longest = max(len(p.split()) for p in prompts)
            assert len(prompts) <= 8 and (len(prompts) == 1 or longest * len(prompts) <= 400)
            return [f"{p[::-1]}" for p in prompts]

        return fn

    got = predict(df, model, batch_size=8, token_budget=400).collect()
    assert [(r["id"], r["prediction"]) for r in got] == [(i, t and t[::-1]) for i, t in rows]
    vectors = embed_tokens(df, lambda: lambda ts: [[[float(len(t))]] for t in ts], "prompt", "v", token_budget=50)
    known = vectors.filter(F.col("v").isNotNull()).select("prompt", F.col("v")[0][0].alias("n")).collect()
    assert all(r["n"] == len(r["prompt"]) for r in known) and len(known) == sum(t is not None for _, t in rows)
