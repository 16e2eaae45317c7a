"""Long texts and many ties: the same results in bounded memory."""

import random
import resource
import time

import pytest
from pyspark.sql import functions as F

from corvane.functions import similarity
from corvane.operators import top


def plain(left, right):
    row = [0] * (len(right) + 1)
    for a in left:
        now = [0]
        for j, b in enumerate(right, 1):
            now.append(row[j - 1] + 1 if a == b else max(row[j], now[-1]))
        row = now
    return row[-1]


@pytest.mark.parametrize("kinds", [1, 2, 5, 40, 1000])
def test_both_ways_give_the_longest_common_subsequence(kinds):
    draw = random.Random(kinds)
    for _ in range(60):
        left, right = ([str(draw.randrange(kinds)) for _ in range(draw.choice([0, 1, 7, 60, 150]))] for _ in range(2))
        want = plain(left, right)
        assert similarity.common_subsequence(left, right) == want
        places = {}
        for i, token in enumerate(left):
            places.setdefault(token, []).append(i)
        known = [t for t in right if t in places]
        assert similarity._by_matches(places, known) == similarity._by_bits(places, known, len(left)) == want


@pytest.mark.parametrize("kinds", [30, 5_000, 10**9])
def test_two_hundred_thousand_words(kinds):
    """Few kinds of words, a natural spread, and nearly all different ones."""
    draw = random.Random(2)
    pick = lambda: int(kinds ** draw.random()) if kinds == 5_000 else draw.randrange(kinds)
    left = [f"w{pick()}" for _ in range(200_000)]
    right = [w if draw.random() < 0.7 else f"w{pick()}" for w in left]
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    assert 0.7 * len(left) < similarity.common_subsequence(left, right) <= len(left)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # KB
    assert time.process_time() - start < 120


def test_the_most_frequent_of_many_ties(spark, monkeypatch):
    monkeypatch.setattr(top, "AT_ONCE", 100)
    monkeypatch.setattr(top, "PARTS", 7)
    counts = spark.range(5000).select(F.col("id").cast("string").alias("t"), F.when(F.col("id") < 20, 9).otherwise(1).alias("n"))
    want = sorted(((r["t"], r["n"]) for r in counts.collect()), key=lambda r: (-r[1], r[0]))
    for n in (5, 20, 30, 6000):
        got = top.most_frequent(counts, n, "n", "t").collect()
        assert sorted(map(tuple, got)) == sorted(want[:n])
    assert top.most_frequent(counts.limit(0), 3, "n", "t").collect() == []
