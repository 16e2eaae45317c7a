"""Nearest neighbours against all distances."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, query_id string, vector string, rank int"


def plain(rows, k):
    valid = [
        (i, v)
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    asked = {}
    for i, v in valid:
        if i % 100 == 0:
            asked[i] = min(v, asked.get(i, v))
    out = []
    for i, v in asked.items():
        near = sorted((math.dist(v, w), j) for j, w in valid if j != i and len(w) == len(v))[:k]
        out += [(i, rank, j, far) for rank, (far, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 4096])
@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e18])
def test_nearest_are_exact(spark, block, scale):
    draw = random.Random(4)
    f = lambda x: float(__import__("numpy").float32(x))
    vec = lambda n: [f(draw.gauss(0, 1) * scale) for _ in range(n)]
    one = vec(8)
    rows = [(i, one if i % 3 == 0 else vec(8)) for i in range(420)]  # a third are copies
    rows += [(1000, None), (1100, [0.0] * 8), (1200, [f(scale), None] * 4), (1300, [float("nan")] * 8)]
    rows += [(1400, [float("inf")] * 8), (1500, []), (None, one), (1600, vec(3)), (1601, vec(3)), (1700, vec(2))]
    rows += [(200, vec(8)), (5, vec(8)), (5, vec(8)), (1800, [f(v * 100) for v in one])]
    df = spark.createDataFrame([(i, v, "a", "b", 1) for i, v in rows], SCHEMA)
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10, query_block=2, candidate_block=block)
    got = sorted(tuple(r) for r in got.collect())
    want = plain(rows, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-12)


@pytest.mark.parametrize("block", [3, 4096])
def test_components_of_any_size(spark, block):
    """Squares beyond the range of doubles, in either direction, lose nobody."""
    draw = random.Random(7)
    sizes = [1e200, 1e155, 1.0, 1e-155, 1e-200, 5e-324, 1e307]
    rows = [(0, [1e200, 1.0]), (1, [2e200, 1.0]), (2, [1e155, 2.0]), (3, [3.0, 4.0]), (4, [1e200, 1.0])]
    rows += [(i, [draw.gauss(0, 1) * draw.choice(sizes) for _ in range(2)]) for i in range(5, 60)]
    rows += [(100 * i, [draw.choice(sizes), draw.choice(sizes) * draw.random()]) for i in range(1, 9)]
    df = spark.createDataFrame([(i, v, "a", "b", 1) for i, v in rows], SCHEMA.replace("float", "double"))
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, 5, query_block=2, candidate_block=block).collect()
    want = plain(rows, 5)
    assert sorted(r[:3] for r in map(tuple, got)) == [w[:3] for w in want]
    assert [r[3] for r in sorted(map(tuple, got))] == pytest.approx([w[3] for w in want], rel=1e-12, abs=0)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect() == []
